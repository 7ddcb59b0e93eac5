"""Pictures taken apart by markers: what passes, and what is left of it."""

import pytest

from wayfare.sources import readers


def segment(mark, payload):
    return bytes((0xFF, mark)) + (len(payload) + 2).to_bytes(2, "big") + payload


def frame(width=12, height=8, parts=3, mark=0xC0):
    return segment(mark, bytes((8,)) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes((parts,)) + b"\1\x11\0" * parts)


TABLES = segment(0xDB, b"\0" * 65) + segment(0xC4, b"\0" * 20)
SCAN = segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\x00\x34\xff\xd0\x56\xff\xff\xd7\x78"
END = b"\xff\xd9"


def picture(*parts):
    return b"\xff\xd8" + b"".join(parts)


def test_what_applications_and_comments_add_goes():
    clean = picture(TABLES, frame(), SCAN, END)
    full = picture(segment(0xE0, b"JFIF"), segment(0xE1, b"Exif Phone 12.9,77.6"), segment(0xFE, b"secret comment"), TABLES, b"\xff\xff" + frame(), SCAN, segment(0xED, b"late"), END)
    assert readers.stripped_jpeg(full) == (12, 8, clean) and readers.stripped_jpeg(clean) == (12, 8, clean)
    assert readers.jpeg_facts(full) == (12, 8, len(clean))


def test_progressive_grey_and_several_scans():
    grey = picture(TABLES, frame(9, 5, 1, 0xC2), SCAN, segment(0xC4, b"\0" * 9), SCAN, END)
    assert readers.stripped_jpeg(grey) == (9, 5, grey)


@pytest.mark.parametrize("mark", [0xE0, 0xE1, 0xEE, 0xFE])
def test_segments_after_the_scan_go_too(mark):
    got = readers.stripped_jpeg(picture(TABLES, frame(), SCAN, segment(mark, b"after-scan secret"), END))
    assert got is not None and b"secret" not in got[2] and got[2].endswith(END)


@pytest.mark.parametrize(
    "bad",
    [
        None, b"", b"\xff\xd8", b"\x89PNG\r\n\x1a\n", picture(END), picture(TABLES, frame(), SCAN, END, b"A"), picture(TABLES, frame(), SCAN), picture(TABLES, frame(), SCAN, b"\xff"), picture(SCAN, frame(), END),
        picture(frame(), END), picture(b"\xff\xe0\xff\xff\0"), picture(TABLES, frame(2001, 8), SCAN, END), picture(TABLES, frame(0, 8), SCAN, END), picture(TABLES, frame(parts=4), SCAN, END),
        picture(TABLES, frame(), frame(13), SCAN, END), picture(b"\xff\xd0", TABLES, frame(), SCAN, END), picture(b"\0", TABLES, frame(), SCAN, END), picture(segment(0xC0, b"\x08\0\x08"), SCAN, END), picture(TABLES, frame(), SCAN, b"\xff\xd8", END),
    ],
)
def test_what_is_refused(bad):
    assert readers.stripped_jpeg(bad) is None


def test_folder_of_pictures(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(picture(segment(0xE1, b"place"), TABLES, frame(), SCAN, END))
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    got = {r["path"][-5:]: (r["width"], r["height"], r["bytes"], r["picture"]) for r in readers.pictures(spark, str(tmp_path)).collect()}
    clean = picture(TABLES, frame(), SCAN, END)
    assert got == {"a.jpg": (12, 8, len(clean), clean), "b.jpg": (None, None, None, None)}
