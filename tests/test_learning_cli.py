"""search and train of an encoder on a built dataset, by the command line."""

import json
from pathlib import Path

from cladewise import cli
from cladewise.functions.schema import LEVELS, Oversampling
from cladewise.operators import trainer
from cladewise.plans import build as plan

from .test_build import built  # noqa: F401


def test_search_and_train_an_encoder(spark, built):  # noqa: F811
    layout = built[0]
    plan.augment(spark, layout, Oversampling(floor=3))
    common = ["--data-dir", layout.top, "--min-class-count", "1", "--epochs", "1", "--batch-size", "4", "--architecture", "Transformer"]
    folder = Path(layout.top) / "found"
    assert cli.main(["search", *common, "--trials", "1", "--samples-per-epoch", "8", "--output", str(folder), "--storage", str(folder / "j")]) == 0
    rows = json.loads((folder / "trials.json").read_text())
    assert [r["number"] for r in rows] == [0] and rows[0]["state"] in ("COMPLETE", "PRUNED") and (folder / "j").exists()
    (folder / "params.json").write_text(json.dumps({"params": rows[0]["params"]}))
    out = Path(layout.top) / "trained"
    assert cli.main(["train", *common, "--params", str(folder / "params.json"), "--workers", "2", "--output", str(out)]) == 0
    assert trainer.load_weights(out / "best.npz")["stem.w"].shape[0] in (6, 8, 12)
    assert len(json.loads((out / "history.json").read_text())) == 1
    report = json.loads((out / "report.json").read_text())
    assert {r["level"] for r in report} <= set(LEVELS) and (out / "report.txt").read_text().startswith("level")
    assert cli.main(["train", *common, "--params", str(folder / "params.json"), "--resume", "--output", str(out)]) == 0
    assert cli.main(["train", *common[:-1], "RNN", "--params", "x"]) == 2
