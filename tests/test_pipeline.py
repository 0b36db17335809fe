import json

import numpy as np
import pytest

from quirework import cli
from quirework.operators import ocr
from quirework.plans.pipeline import Pipeline, document_pdfs, manifest
from quirework.sources.images import png
from tests.test_image import ruled


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/ruled.png").write_bytes(png(ruled()))
    return tmp_path


def test_phases(spark, folder, monkeypatch):
    class Fixed:
        name = "fixed"

        def is_available(self):
            return True

        def run(self, image):
            return [ocr.Word("word", 0.75)]

    monkeypatch.setitem(ocr.ENGINES, "fixed", Fixed)
    p = Pipeline(spark, [f"{folder}/in"], engine="fixed")
    out = p.run_all()
    assert set(out) == {"assessment", "enhanced", "regions", "crops", "words"}
    assert p.document_flags().first().page_count == 1 and p.summary().first().pages == 1
    counts = {r.type: r.n for r in p.count_by_type().collect()}
    assert counts["table"] == 1 and "cell" not in counts
    m = manifest(out["crops"]).collect()
    assert all(r.has_image for r in m) and len(m) == out["regions"].count()
    assert {r.confidence_e4 for r in p.region_results().collect()} == {7500}
    assert bytes(document_pdfs(out["enhanced"]).first().pdf).startswith(b"%PDF")
    # an earlier phase run again voids the later ones
    p.detect_layout()
    assert "words" not in p._done and "assessment" in p._done


def test_command_line(spark, folder, capsys):
    assert cli.main(["version"]) == 0
    assert cli.main(["assess", f"{folder}/in", "--json"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()[1:]]
    assert rows[0]["doc_id"] == "ruled" and rows[0]["width_px"] == 800
    assert cli.main(["extract-layouts", f"{folder}/in", "-o", f"{folder}/out"]) == 0
    crop = spark.read.parquet(f"{folder}/out/crops").where("region_id = 'cell_001'").first()
    assert bytes(crop.png).startswith(b"\x89PNG")
    with pytest.raises(SystemExit):
        cli.main(["assess"])
    with pytest.raises(RuntimeError):
        cli.main(["ocr", f"{folder}/in"])
