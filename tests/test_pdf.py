import random
import zlib

from weftline.sources.pdf import pdf_text


def pdf(objects, trailer="", xref_stream=False, packed=()):
    """A file of (number, body bytes); numbers in ``packed`` go to an object stream."""
    out, places = b"%PDF-1.7\n", {}
    objects = dict(objects)
    size = max(objects) + 3
    inner = {n: objects.pop(n) for n in packed}
    if inner:
        head, body = "", b""
        for n, x in inner.items():
            head += f"{n} {len(body)} "
            body += x + b" "
        data = zlib.compress(head.encode() + body)
        objects[size - 2] = f"<</Type/ObjStm/N {len(inner)}/First {len(head)}/Filter/FlateDecode/Length {len(data)}>>stream\n".encode() + data + b"\nendstream"
    for n, body in objects.items():
        places[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    if not xref_stream:
        out += f"xref\n0 {size}\n".encode() + b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(size))
        return out + f"trailer <</Size {size}/Root 1 0 R{trailer}>>\nstartxref\n{at}\n%%EOF".encode()
    places[size - 1] = at
    rows = []
    for n in range(size):
        kind, where, third = (2, size - 2, list(inner).index(n)) if n in inner else (1, places[n], 0) if n in places else (0, 0, 0)
        rows.append(bytes([kind]) + where.to_bytes(3, "big") + bytes([third]))
    above, coded = bytes(5), b""
    for r in rows:  # stored as differences to the row above
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above))
        above = r
    data = zlib.compress(coded)
    about = f"<</Type/XRef/Size {size}/W[1 3 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 5>>/Length {len(data)}{trailer}>>"
    return out + f"{size - 1} 0 obj\n{about}stream\n".encode() + data + f"\nendstream\nendobj\nstartxref\n{at}\n%%EOF".encode()


def stream(data, more="", pack=False):
    data = zlib.compress(data) if pack else data
    return f"<</Length {len(data)}{more}{'/Filter/FlateDecode' if pack else ''}>>stream\n".encode() + data + b"\nendstream"


def one_page(content, font=b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", **how):
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", 4: content, 5: font}
    return pdf({**objects, **how.pop("more", {})}, **how)


RESUME = rb"BT /F1 12 Tf 72 720 Td (Jane \(J.\) Doe) Tj 0 -14 Td [(Back) -20 (end) -300 (Engineer)] TJ T* (Oslo\054 Norway) ' 1 0 0 1 72 600 Tm <6A616E6540782E6578616D706C65> Tj ET"


def test_tables_streams_and_packed_objects():
    want = "Jane (J.) Doe\nBackend Engineer\nOslo, Norway\njane@x.example"
    assert pdf_text(one_page(stream(RESUME))) == (want, None)
    assert pdf_text(one_page(stream(RESUME, pack=True))) == (want, None)
    assert pdf_text(one_page(stream(RESUME, pack=True), xref_stream=True)) == (want, None)
    assert pdf_text(one_page(stream(RESUME, pack=True), xref_stream=True, packed=(1, 2, 3, 5))) == (want, None)
    hexed = b"<</Length 7 0 R/Filter[/ASCIIHexDecode/FlateDecode]>>stream\n" + zlib.compress(RESUME).hex().encode() + b">\nendstream"
    n = len(zlib.compress(RESUME).hex()) + 1
    assert pdf_text(one_page(hexed, more={7: str(n).encode()})) == (want, None)


def test_maps_differences_forms_and_pages():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00C5> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660066> <0069>] endbfrange"
    font = b"<</Type/Font/Subtype/Type0/ToUnicode 6 0 R>>"
    assert pdf_text(one_page(stream(b"BT /F1 9 Tf <000100020010001100120020> Tj ET"), font, more={6: stream(cmap, pack=True)})) == ("Å😀abcff", None)
    named = b"<</Type/Font/Subtype/Type1/Encoding<</Differences[1/A/uni00E9/at 65/quoteright]>>>>"
    assert pdf_text(one_page(stream(b"BT /F1 9 Tf (\x01\x02\x03AB) Tj ET"), named)) == ("Aé@’B", None)
    form = stream(b"BT /F1 9 Tf (inside) Tj ET", "/Type/XObject/Subtype/Form/Resources<</Font<</F1 5 0 R>>>>")
    page = b"<</Type/Page/Parent 2 0 R/Contents[4 0 R 8 0 R]/Resources<</Font<</F1 5 0 R>>/XObject<</X 7 0 R>>>>>>"
    more = {3: page, 7: form, 8: stream(b"BT (after) Tj ET BI /W 1 ID \x01(x\xff EI /X Do")}
    assert pdf_text(one_page(stream(b"BT /F1 9 Tf (before) Tj ET"), more=more)) == ("before\nafter\ninside", None)
    two = {2: b"<</Kids[3 0 R 9 0 R]>>", 3: b"<</Contents 4 0 R>>", 9: b"<</Kids[10 0 R]/Resources<</Font<</F1 5 0 R>>>>>>", 10: b"<</Contents 4 0 R>>"}
    assert pdf_text(one_page(stream(b"BT (page) Tj ET"), more=two)) == ("page\n\npage", None)


def test_updates_the_later_object_stands():
    first = one_page(stream(b"BT /F1 9 Tf (old) Tj ET"))
    at = len(first)
    body = b"\n4 0 obj\n" + stream(b"BT /F1 9 Tf (new) Tj ET") + b"\nendobj\n"
    prev = first.rsplit(b"startxref\n", 1)[1].split(b"\n")[0].decode()
    update = first + body + b"xref\n4 1\n%010d 00000 n \ntrailer <</Root 1 0 R/Prev %s>>\nstartxref\n%d\n%%%%EOF" % (at + 1, prev.encode(), at + len(body))
    assert pdf_text(update) == ("new", None)


def test_what_has_no_text_says_why():
    good = one_page(stream(RESUME, pack=True), xref_stream=True, packed=(1, 2, 3, 5))
    assert pdf_text(b"no file") == (None, "malformed: no cross-reference")
    assert pdf_text(one_page(stream(RESUME), trailer="/Encrypt<</V 1>>")) == (None, "malformed: encrypted")
    assert pdf_text(one_page(stream(b""))) == (None, "empty input")
    assert pdf_text(one_page(b"<</Length 3/Filter/FlateDecode>>stream\nabc\nendstream")) == (None, "malformed: broken stream")
    assert pdf_text(one_page(b"<</Length 3/Filter/LZWDecode>>stream\nabc\nendstream")) == (None, "unsupported: LZWDecode")
    assert pdf_text(one_page(stream(RESUME)).replace(b"startxref\n", b"startxref\n9"))[1].startswith("malformed")
    loop = one_page(stream(RESUME), more={2: b"<</Kids[2 0 R]>>"})
    assert pdf_text(loop) == (None, "empty input")
    rng = random.Random(9)
    for _ in range(300):  # broken anywhere: a text or a reason, never an exception
        data = bytearray(good)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        text, why = pdf_text(bytes(data[: rng.choice([len(data), rng.randrange(1, len(data))])]))
        assert (text is None) != (why is None)
