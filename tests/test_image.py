import numpy as np
import pytest

from quirework.config import Config, load, override
from quirework.functions import image as I
from quirework.sources import images as S


def square():
    g = np.zeros((100, 100), np.uint8)
    g[40:60, 40:60] = 255
    return g


def ruled():
    img = np.full((600, 800), 255, np.uint8)
    for y in (100, 160, 220, 280):
        img[y : y + 2, 100:700] = 0
    for x in (100, 300, 500, 698):
        img[100:282, x : x + 2] = 0
    return img


def test_scores():
    assert round(I.blur_score(square()), 2) == 1092.42 and round(I.contrast_score(square()), 4) == 49.9696
    flat = np.full((20, 30), 180, np.uint8)
    assert I.blur_score(flat) == I.contrast_score(flat) == I.noise_score(flat) == 0.0 and I.otsu(flat) == 0
    assert I.otsu(square()) == 0 and I.histogram(square()).sum() == pytest.approx(1)
    one = np.array([[7]], np.uint8)
    assert I.blur_score(one) == 0.0 and I.noise_score(one) == 0.0


def test_gray_and_back():
    bgr = np.zeros((2, 2, 3), np.uint8)
    bgr[..., 2] = 255
    assert (I.to_gray(bgr) == 76).all() and I.to_bgr(I.to_gray(bgr)).shape == (2, 2, 3)


@pytest.mark.parametrize("tilt", [-7, -3, 0, 4])
def test_skew_is_taken_out(tilt):
    t = np.full((400, 400), 255, np.uint8)
    for y in range(60, 340, 40):
        t[y : y + 3, 40:360] = 0
    r = I.rotate(t, tilt)
    assert abs(I.skew_angle(r) + tilt) <= 1
    assert abs(I.skew_angle(I.deskew(r, I.skew_angle(r)))) <= 1


@pytest.mark.parametrize("op", [I.denoise, I.clahe, I.sharpen, lambda x: I.rotate(x, 5.0), I.reconstruct_table_borders])
@pytest.mark.parametrize("shape", [(50, 60), (50, 60, 3)])
def test_shape_and_type_stay(op, shape):
    out = op(np.full(shape, 128, np.uint8))
    assert out.shape == shape and out.dtype == np.uint8


def test_denoise_smooths_and_sharpen_sharpens():
    rng = np.random.default_rng(0)
    noisy = np.clip(128 + rng.normal(0, 6, (60, 60)), 0, 255).astype(np.uint8)
    assert I.denoise(noisy).std() < noisy.std() < I.sharpen(noisy).std()


def test_morphology_by_brute_force():
    rng = np.random.default_rng(1)
    m = rng.random((17, 19)) < 0.3
    for kw, kh in ((3, 1), (4, 2), (1, 5), (2, 2)):
        want = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m)):
            want[max(0, y - kh // 2) : y - kh // 2 + kh, max(0, x - kw // 2) : x - kw // 2 + kw] = True
        assert (I.dilate(m, kw, kh) == want).all()
        assert (I.opening(m, kw, kh) <= m).all() and (I.closing(m, kw, kh)[3:-3, 3:-3] >= m[3:-3, 3:-3]).all()


def test_components_by_flood():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.random((12, 14)) < 0.35
        left, want = {tuple(p) for p in np.argwhere(m)}, []
        while left:
            todo, own = [left.pop()], []
            while todo:
                y, x = todo.pop()
                own.append((y, x))
                for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if n in left:
                        left.remove(n)
                        todo.append(n)
            ys, xs = zip(*own)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        assert sorted(I.boxes(m)) == sorted(want)


def test_table_with_cells():
    r = I.detect_page(ruled(), Config().layout)
    assert [x[0] for x in r].count("table") == 1 and [x[0] for x in r].count("cell") == 9
    assert all(x[2] == 0 for x in r if x[0] == "cell")
    merged = I.detect_page(ruled(), override(Config().layout, {"merged_column": 1}))
    assert [x[0] for x in merged].count("cell") == 8


def test_blank_and_text_pages():
    assert I.detect_page(np.full((800, 600, 3), 255, np.uint8), Config().layout) == []
    page = np.full((800, 600), 255, np.uint8)
    for y in (200, 215, 230, 400, 415):
        page[y : y + 8, 30:570] = 30
    r = I.detect_page(page, Config().layout)
    assert sum(x[0] in ("paragraph", "title", "image") for x in r) >= 2
    assert all(0 <= x and 0 <= y and x + w <= 600 and y + h <= 800 for _, (x, y, w, h), _ in r)


def test_places_and_lines():
    assert I.merge_nearby([1, 3, 5, 20, 22, 40], 5) == [3, 21, 40] and I.merge_nearby([], 5) == []
    assert I.count_rising(np.array([9, 0, 9, 9, 0, 9]), 5) == 2
    assert not I.has_content(np.full((9, 9), 255, np.uint8)) and I.has_content(np.zeros((9, 9), np.uint8)) and not I.has_content(np.zeros((0, 9), np.uint8))


def test_hashes():
    g = ruled()
    for f in (I.phash, I.dhash, I.ahash):
        assert len(f(g)) == 64 and I.hash_distance(f(g), f(g)) == 0
    assert all(len(h) == 16 for h in I.all_hashes(g))
    assert I.hash_distance(I.phash(g), I.phash(I.sharpen(g))) <= 10 < I.hash_distance(I.phash(g), I.phash(np.rot90(g)))


def test_png_and_pdf(spark, tmp_path):
    g = ruled()
    bgr = I.draw_regions(g, [(10, 10, 50, 40, "table"), (100, 100, 20, 20, "title")])
    (tmp_path / "one.png").write_bytes(S.png(g))
    (tmp_path / "two.png").write_bytes(S.png(bgr, 0))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    got = {r.doc_id: r for r in S.pages(spark, [f"{tmp_path}/*.png"]).collect()}
    assert set(got) == {"one", "two"}
    two = np.frombuffer(bytes(got["two"].data), np.uint8).reshape(600, 800, 3)
    assert (two == bgr).all() and (got["one"].height, got["one"].width) == (600, 800)
    p = S.pdf([g, bgr])
    assert p.startswith(b"%PDF") and p.count(b"/Type /Page ") == 2 and b"192.0000" in p
    with pytest.raises(ValueError):
        S.pdf([])


def test_pdf_source_needs_a_renderer(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    S._RENDERER.clear()
    with pytest.raises(RuntimeError):
        S.pages(spark, [f"{tmp_path}/a.PDF"])
    S.register_renderer(lambda content, dpi: iter([np.zeros((4, 5), np.uint8), np.zeros((4, 5, 3), np.uint8)]))
    assert [(r.doc_id, r.page_number, r.n_channels, len(r.data)) for r in S.pages(spark, [f"{tmp_path}/a.PDF"]).orderBy("page_number").collect()] == [("a", 1, 1, 20), ("a", 2, 3, 60)]


def test_config(tmp_path):
    c = Config()
    assert c.get("assessment.blur_threshold") == 100.0 and c.get("assessment.none.deeper", 7) == 7 and c.section("nothing") == {} and c.get("ocr")["lang"] == "en"
    (tmp_path / "c.json").write_text('{"assessment": {"blur_threshold": 50}}')
    assert load(str(tmp_path / "c.json")).assessment.blur_threshold == 50 and load().assessment.noise_threshold == 0.02
    with pytest.raises(KeyError):
        override(c, {"assessment": {"nothing": 1}})
