import numpy as np
import pytest

from foliospark.operators import content, pixels


def words_on_a_sheet(seed, height, width, paper=255, ink=10):
    """A straight grey sheet with words of random lengths in lines of random heights."""
    rng = np.random.default_rng(seed)
    sheet = np.full((height, width), paper, np.uint8)
    y = height // 8
    while y < height * 7 // 8:
        tall, x = int(rng.integers(9, 15)), width // 7
        while x < width * 5 // 7:
            long = int(rng.integers(18, 90))
            sheet[y : y + tall, x : min(x + long, width * 5 // 7)] = ink
            x += long + int(rng.integers(7, 13))
        y += int(rng.integers(31, 37))
    return sheet


def laid_down(sheet, degrees, size, desk):
    """The sheet, turned about its middle, in the middle of a desk; each pixel shows what lies under it."""
    height, width = size
    y, x = np.indices(size) - np.array([height / 2, width / 2])[:, None, None]
    a = np.deg2rad(degrees)
    row = np.rint(sheet.shape[0] / 2 - np.sin(a) * x + np.cos(a) * y).astype(int)
    column = np.rint(sheet.shape[1] / 2 + np.cos(a) * x + np.sin(a) * y).astype(int)
    on = (row >= 0) & (row < sheet.shape[0]) & (column >= 0) & (column < sheet.shape[1])
    out = np.empty((*size, *sheet.shape[2:]), np.uint8)
    out[:] = desk
    out[on] = sheet[row[on], column[on]]
    return out


def scan(degrees):
    return laid_down(words_on_a_sheet(3, 1300, 1000), degrees, (1500, 1150), 255)


@pytest.mark.parametrize("degrees", [0, 2.5, -5, 8])
def test_skew(degrees):
    found = pixels.measure_skew(scan(degrees))
    assert abs(found.degrees - degrees) <= 0.3 and found.bounds is not None and found.fits(1150, 1500)


def test_no_skew():
    assert pixels.measure_skew(np.full((70, 90), 230, np.uint8)) == pixels.Skew(0)
    assert pixels.measure_skew(scan(4), 0).degrees == 0
    assert not pixels.Skew(0).fits(10, 10) and not pixels.Skew(2, (9, 9, 57, 40)).fits(60, 50) and pixels.Skew(2, (4, 4, 56, 46)).fits(60, 50)


def test_coloured_paper():
    grey_sheet = words_on_a_sheet(8, 900, 500, paper=200, ink=0)
    sheet = np.stack([grey_sheet // 2, grey_sheet, grey_sheet // 3], axis=-1)
    page = laid_down(sheet, 12, (1400, 1000), (250, 250, 245))
    assert abs(pixels.measure_skew(page).degrees - 12) <= 0.5
    flat, straight = pixels.flatten(page), laid_down(grey_sheet, 12, (1400, 1000), 255)
    assert np.median(flat[straight == 200]) > 200 and np.median(flat[straight == 0]) < 60 and flat[:30].min() > 240


def test_ink_and_enhancement():
    empty, full = np.full((500, 420), 240, np.uint8), words_on_a_sheet(1, 500, 420, paper=240)
    assert pixels.spread(pixels.shrink(empty)) == 0 and pixels.spread(pixels.shrink(full)) > 12
    faded = (180 + full // 6).astype(np.uint8)
    better = pixels.enhance(faded)
    inner = np.s_[1:-1, 1:-1]
    assert better.shape == faded.shape and np.median(better[inner][full[inner] == 10]) < 120 < 230 < np.median(better[inner][full[inner] == 240]) and pixels.spread(better) > pixels.spread(faded)
    assert pixels.mean_of_nine(np.ones((2, 2))).sum() == 0


def test_local_mean_by_hand():
    g = np.random.default_rng(1).random((9, 7))
    got = pixels.local_mean(g, 2)
    for y, x in ((0, 0), (4, 3), (8, 6)):
        assert got[y, x] == pytest.approx(g[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean())


def test_on_spark(spark):
    page = scan(2.5)
    rows = spark.createDataFrame([(1, bytearray(page.tobytes()), 1150, 1500, 1), (2, bytearray(b"\xe6" * 77), 11, 7, 1)], "page int, pixels binary, width int, height int, stride int")
    got = {r.page: r for r in pixels.with_ink(rows).select("page", "ink", pixels.skew_of("pixels", "width", "height", "stride").alias("s")).collect()}
    assert got[1].ink and not got[2].ink and abs(got[1].s.degrees - 2.5) <= 0.3 and got[2].s.x0 is None
    flat = rows.select(pixels.flattened("pixels", "width", "height", "stride").alias("f"), pixels.enhanced("pixels", "width", "height", "stride").alias("e")).collect()
    assert len(flat[0].f) == len(flat[0].e) == 1150 * 1500


#: What shows a text, how a text is written, and text that looks like operators but isn't.
SHOWS = {"Tj": "{} Tj", "TJ": "[ {} 7 {} ] TJ", "'": "{} '", '"': '1 2 {} "'}
STRINGS = {"plain": "(word)", "escaped": "(a \\) ET BT b)", "nested": "(a (ET) b)", "hexadecimal": "<4554204254>", "empty": "()"}
DECOYS = {"comment": "% BT ET (x) Tj", "name": "/BT /ET gs", "image": "BI /W 1 ID \x01BT ET 3 Tr EI", "string": "(BT 3 Tr) pop", "path": "4 5 m 6 7 l S"}


@pytest.mark.parametrize("show", SHOWS)
@pytest.mark.parametrize("string", STRINGS)
def test_each_mode_in_each_form(show, string):
    shown = SHOWS[show].format(*[STRINGS[string]] * 2)
    for mode in range(8):
        visible = mode not in (3, 7)
        inside, before = f"BT {mode} Tr 9 0 0 9 1 2 Tm {shown} ET", f"{mode} Tr\nBT {shown} ET"
        within = f"q {mode} Tr BT {shown} ET Q"
        for stream, left in ((inside, "\n"), (before, f"{mode} Tr\n\n"), (within, f"q {mode} Tr \n Q")):
            got = content.without_invisible_text(f"1 0 0 rg\n{stream}\n0 g".encode("latin-1")).decode("latin-1")
            assert got == f"1 0 0 rg\n{stream if visible else left}\n0 g", (stream, got)


@pytest.mark.parametrize("decoy", DECOYS)
def test_what_looks_like_text_stays(decoy):
    hidden = "BT 3 Tr (gone) Tj ET"
    for stream, want in ((DECOYS[decoy], DECOYS[decoy]), (f"{DECOYS[decoy]}\n{hidden}", f"{DECOYS[decoy]}\n\n"), (f"{hidden}\n{DECOYS[decoy]}", f"\n\n{DECOYS[decoy]}")):
        assert content.without_invisible_text(stream.encode("latin-1")).decode("latin-1") == want


def test_the_state_is_followed():
    strip = lambda s: content.without_invisible_text(s.encode()).decode()
    kept = "BT 3 Tr (one) Tj 1 Tr (two) Tj ET"
    assert strip(kept) == kept  # an object with anything visible stays whole
    assert strip("q 3 Tr Q BT (seen) Tj ET") == "q 3 Tr Q BT (seen) Tj ET" and strip("q 3 Tr q Q BT (x) Tj ET") == "q 3 Tr q Q \n"
    assert strip("BT 7 Tr (x) Tj ET 5 w BT (y) Tj ET") == "\n 5 w \n"  # a mode goes on behind its object
    assert strip("3 Tr 8 w BT (x) Tj") == "3 Tr 8 w \n"  # what isn't closed runs to the end
    assert strip("") == "" and strip("(never closed BT 3 Tr") == "(never closed BT 3 Tr" and strip("BT ET") == "\n"


def test_streams_on_spark(spark):
    rows = spark.createDataFrame([(bytearray(b"3 Tr BT (a) Tj ET"), [bytearray(b"3 Tr"), bytearray(b"BT (a) Tj ET")]), (None, None)], "s binary, parts array<binary>")
    got = rows.select(content.strip_invisible("s").alias("s"), content.joined_and_stripped("parts").alias("p")).collect()
    assert bytes(got[0].s) == b"3 Tr \n" and bytes(got[0].p) == b"3 Tr\n\n" and got[1].s is None and got[1].p is None


def test_forms_and_glyphs():
    hidden = b"BT 3 Tr (x) Tj ET"
    forms = {f"f{i}": (hidden, [f"f{i + 1}", "f0"]) for i in range(9)}
    assert sorted(content.strip_forms(forms, ["f0", "other"])) == [f"f{i}" for i in range(6)]
    glyph = {"unicode": "a"}
    assert content.glyphs([[glyph, {"unicode": " "}, 5, {"unicode": None}, [glyph]]]) == 3 and content.glyphs([[[[glyph]]]]) == 0
    assert content.visible_characters([("show", [[glyph] * 3]), ("save", []), ("mode", [3]), ("show", [[glyph]]), ("restore", []), ("show", [[glyph]]), ("restore", [])]) == 4
