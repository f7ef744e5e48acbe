"""International numbers against the numbering plan: which calling code a number begins with, and how long its national part may be."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

# Digits of the national part, fewest and most, by calling code.
LENGTHS = {
    1: (10, 10), 7: (10, 10), 20: (8, 10), 27: (9, 9), 30: (10, 10), 31: (9, 11), 32: (8, 9), 33: (9, 9), 34: (9, 9), 36: (8, 9), 39: (6, 12), 40: (9, 9), 41: (9, 12), 43: (4, 13), 44: (7, 10), 45: (8, 8),
    46: (6, 10), 47: (5, 8), 48: (9, 9), 49: (5, 13), 51: (8, 9), 52: (10, 10), 53: (6, 8), 54: (10, 11), 55: (10, 11), 56: (9, 9), 57: (8, 10), 58: (10, 10), 60: (8, 10), 61: (9, 9), 62: (7, 12), 63: (8, 10),
    64: (8, 10), 65: (8, 8), 66: (8, 9), 81: (9, 10), 82: (8, 11), 84: (7, 10), 86: (9, 11), 90: (10, 10), 91: (10, 10), 92: (9, 10), 93: (9, 9), 94: (9, 9), 95: (7, 10), 98: (10, 10),
    212: (9, 9), 213: (8, 9), 216: (8, 8), 218: (8, 9), 220: (7, 7), 221: (9, 9), 233: (9, 9), 234: (8, 10), 251: (9, 9), 254: (7, 10), 255: (9, 9), 256: (9, 9), 351: (9, 9), 352: (4, 11), 353: (7, 9),
    354: (7, 9), 358: (5, 12), 359: (7, 9), 370: (8, 8), 371: (8, 8), 372: (7, 8), 380: (9, 9), 385: (8, 9), 420: (9, 9), 421: (9, 9), 852: (8, 8), 853: (8, 8), 855: (8, 9), 880: (8, 10), 886: (8, 9),
    961: (7, 8), 962: (8, 9), 963: (8, 9), 964: (8, 10), 965: (8, 8), 966: (8, 9), 968: (8, 8), 971: (8, 9), 972: (8, 9), 973: (8, 8), 974: (8, 8), 977: (8, 10), 992: (9, 9), 994: (9, 9), 995: (9, 9), 996: (9, 9), 998: (9, 9),
}
# Tens of calling codes that nobody has, and single ones.
UNASSIGNED_TENS = (28, 83, 89)
UNASSIGNED = (210, 214, 215, 217, 219, 259, 292, 293, 294, 295, 296, 384, 388, 422, 424, 425, 426, 427, 428, 429, 693, 694, 695, 696, 697, 698, 699, 801, 802, 803, 804, 805, 806, 807, 809, 851, 854, 857, 858, 859, 871, 872, 873, 874, 884, 885, 887, 889, 969, 978, 990, 997, 999)
#: National digits where a code's own are not listed.
OTHERS = (4, 12)


@cache
def plan() -> list[int]:
    """By the first three digits of a number: digits of its calling code, fewest and most of its national part, as one number; 0 for no code.

    The longest prefix is found once for all thousand beginnings: codes of one and two digits are those listed, every other three digits are a code of their own
    unless nobody has it, and none begins with 0.
    """
    out = []
    for n in range(1000):
        digits = f"{n:03d}"
        code = next((c for c in (digits[:1], digits[:2], digits) if int(c) in LENGTHS and not c.startswith("0")), None)
        if code is None:
            free = digits[0] == "0" or n in UNASSIGNED or n // 10 in UNASSIGNED_TENS
            out.append(0 if free else 30000 + 100 * OTHERS[0] + OTHERS[1])
        else:
            low, high = LENGTHS[int(code)]
            out.append(10000 * len(code) + 100 * low + high)
    return out


def in_plan(number: Column) -> Column:
    """Whether ``+`` and digits begin with a calling code and are as long as its numbers are: one look into a list."""
    listed = F.split(F.lit(",".join(map(str, plan()))), ",")  # folded to one literal list
    found = F.get(listed, F.substring(number, 2, 3).try_cast("int")).cast("int")
    national = F.length(number) - 1 - F.floor(found / 10000)
    return F.coalesce((found > 0) & (national >= F.floor(found % 10000 / 100)) & (national <= found % 100), F.lit(False))
