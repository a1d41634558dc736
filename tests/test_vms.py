"""The foreign format: names, record formats, repair."""

import pytest

from sediment.sources import vms


def test_names():
    assert vms.linux_name("[LAISHEV.VBKS.SUB]V.TXT;2") == "LAISHEV/VBKS/SUB/V.TXT"
    assert vms.linux_name("[LAISHEV]V.TXT;1", "[LAISHEV]V.TXT;2") == "LAISHEV/V.TXT;1"
    assert vms.linux_name("[000000]README.;1") == "README"
    assert vms.linux_name("[A]a^_b^.c.d^U00E9;1") == "A/a b.c.dé"
    with pytest.raises(ValueError):
        vms.linux_name("[^.^.]X.Y;1")


def test_texts():
    lines = b"one\ntwo!\n\nfour\n"
    assert vms.to_text(vms.as_variable(lines), vms.VARIABLE, vms.CARRIAGE_RETURN) == lines
    assert vms.to_text(b"a\r\nb\rc\r\n", vms.STREAM, vms.CARRIAGE_RETURN) == b"a\nb\rc\n"
    assert vms.to_text(b"a\rb\r", vms.STREAM_CR, vms.CARRIAGE_RETURN) == b"a\nb\n"
    assert vms.to_text(b"abc\0def\0", vms.FIXED, vms.CARRIAGE_RETURN, 3) == b"abc\ndef\n"
    assert vms.to_text(b"\x04\0\1\2hi", vms.VFC, vms.PRINT) == b"hi\n"
    assert vms.to_text(b"\x03\x000ab\0\x02\x001x", vms.VARIABLE, vms.FORTRAN) == b"\nab\n\fx\n"
    assert vms.to_text(b"raw", vms.FIXED, 0, 3) == b"raw"


def test_saveset_and_repair():
    texts = {f"D/F{i}.TXT": (b"line %d of a file\n" % i) * (i * 40) for i in range(30)}
    data = vms.write([(f"[D]F{i}.TXT;1", vms.as_variable(t), vms.VARIABLE, vms.CARRIAGE_RETURN) for i, t in enumerate(texts.values())], 4096, 5)
    assert vms.is_saveset(data[:256])
    assert {f["path"]: f["text"] for f in vms.files(data, [])} == texts
    for hurt in (0, 4096 * 7, 4096 * 8):
        bad = bytearray(data)
        bad[hurt + 50 : hurt + 600] = b"\xaa" * 550
        events: list = []
        assert {f["path"]: f["text"] for f in vms.files(bytes(bad), events)} == texts and events
    bad = bytearray(data)
    for b in (6, 7):
        bad[b * 4096 + 300] ^= 255
    events = []
    got = list(vms.files(bytes(bad), events))
    assert {e[0] for e in events} == {"LOST"} and all(f["text"] == texts[f["path"]] for f in got if not f["damaged"])
    assert any(f["damaged"] for f in got) or len(got) < len(texts)
