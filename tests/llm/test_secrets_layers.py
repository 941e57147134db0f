"""Compressed layers are read to their end, whatever their size, members and depth."""

import base64
import gzip
import io
import random
import zlib

import pytest

from tessera.llm import secrets

PLAIN = "password = hunter2hunter2hunter2"


def _wrapped(raw: bytes) -> str:
    return "see " + base64.b64encode(raw).decode() + " end"


def _is_found(text: str) -> bool:
    spans = secrets.scan(text)[1]  # the base64 text itself may look like hex
    return (4, len(text) - 4, "assign") in spans and secrets.redact(text, spans) == "see [SECRET] end"


@pytest.mark.parametrize("filler", ["harmless words, ", "h\u00e4rmlose W\u00f6rter. ", "\u65e5\u672c\u8a9e", "just plain words "])
def test_a_secret_beyond_4_mb_of_an_inflated_layer(filler):
    assert _is_found(_wrapped(zlib.compress(("a" + filler * (5_500_000 // len(filler.encode())) + " " + PLAIN).encode())))
    assert _is_found(_wrapped(zlib.compress((" " + PLAIN + " " + filler * (5_500_000 // len(filler.encode()))).encode())))


@pytest.mark.parametrize("depth", [8, 9, 30])
def test_any_number_of_compressions(depth):
    raw = PLAIN.encode()
    for i in range(depth):
        raw = (gzip, zlib)[i % 2].compress(raw)
    assert _is_found(_wrapped(raw))


def test_all_members_of_gzip():
    raw = gzip.compress(b"nothing here") + gzip.compress(b" or here ") + gzip.compress(PLAIN.encode())
    assert _is_found(_wrapped(raw)) and _is_found(_wrapped(gzip.compress(raw)))


def test_pieces_find_what_the_whole_text_has(monkeypatch):
    """Finds and encoded runs on the edges of pieces, wrapped again and again."""
    rng = random.Random(3)
    percent = lambda s: "".join(f"%{b:02x}" for b in s.encode())
    forms = [PLAIN, percent(PLAIN), percent(percent(PLAIN)), "password%3D  abcdefghijkl12", "token%25253D abcdefghijkl12", "secret :   \"abcdefghijkl12",
             base64.b64encode(PLAIN.encode()).decode(), "AKIA" + "Z" * 5000, "ab12" * 9]
    words = ["lorem", "ipsum dolor", "sit,", "amet", "a b c d", "%20", "x=y"]
    monkeypatch.setattr(secrets, "CHUNK", 5000)
    for form in forms:
        for _ in range(12):
            text = " ".join(rng.choices(words, k=rng.randint(600, 1200))) + " " + form + " " + " ".join(rng.choices(words, k=1500))
            kinds = {s[2] for s in secrets.scan(text)[1]}
            pieces = list(secrets._pieces(io.BytesIO(text.encode())))
            assert len(pieces) > 1 and "".join(pieces) == text
            assert {s[2] for s in secrets.scan(_wrapped(zlib.compress(text.encode())))[1]} == kinds


SECRET = "token = abcdefghijklmnop1234"


@pytest.mark.parametrize("before", ["", "abc", "a", "ab", "a/b/", "path/to/", "x/y-z_", "Q" * 33])
@pytest.mark.parametrize("after", ["", "Zz", "/more/of/it"])
@pytest.mark.parametrize("code", ["utf-8", "utf-16-le", "utf-16-be"])
def test_base64_beside_other_letters(before, after, code):
    run = base64.b64encode(f"some words, {SECRET} and more".encode(code)).decode().rstrip("=")
    text = f"see {before}{run}{after} there"
    _, spans = secrets.scan(text)
    found = [s for s in spans if s[2] == "assign"]
    assert found and all(4 <= a < b <= len(text) - 6 for a, b, _ in found)
    assert any(a <= 4 + len(before) + 20 and b >= 4 + len(before) + len(run) // 2 for a, b, _ in found)


def test_compressed_data_after_a_path():
    run = base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode()
    for before in ("", "a/b/", "abc", "ab"):
        assert any(kind == "assign" for _, _, kind in secrets.scan(f"x {before}{run} y")[1])


@pytest.mark.parametrize("escaped", ["token \\u{3d} abcdefghijklmnop1234", "token &#61; abcdefghijklmnop1234",
                                     "token &#x3D;&#x20;abcdefghijklmnop1234", "&#116;oken\\u{003D}abcdefghijklmnop1234"])
def test_references_and_braced_escapes(escaped):
    text = f"é {escaped} end"
    assert (2, 2 + len(escaped), "assign") in secrets.scan(text)[1]


def test_utf16_with_a_mark():
    run = base64.b64encode(SECRET.encode("utf-16")).decode()
    assert (0, len(run), "assign") in secrets.scan(run)[1]


def test_long_text_of_escapes_is_bounded():
    import tracemalloc
    text = "%41b" * 300_000 + " token%3Dabcdefghijklmnop1234"
    tracemalloc.start()
    _, spans = secrets.scan(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any(kind == "assign" and b == len(text) for _, b, kind in spans)
    assert most < 120 * len(text)


def test_plain_words_have_no_layers():
    text = "Zusammengehoerigkeitsgefuehl " * 50 + "https://a.example.net/some/long/path/of/words_and-more"
    assert secrets.scan(text) == ([], [])
