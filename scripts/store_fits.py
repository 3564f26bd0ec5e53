"""Store the fitted models of the correctness gate's scale for the oracles.

    python scripts/store_fits.py [/root/testdata/sf0.01]

Writes oracle/fitted_sf0.01.json: the model of the training quarters and the
models of the cross-validation folds, as ``LinearSpec`` JSON."""

from __future__ import annotations

import json
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from churnlens.operators import fit, model  # noqa: E402
from churnlens.plans import catalog, jobs  # noqa: E402
from churnlens.session import get_spark  # noqa: E402


def main(sf_dir: str = "/root/testdata/sf0.01") -> None:
    spark = get_spark()
    s = catalog.train_split(spark, sf_dir)
    live = [f["q"] for f in model.fold_conditions(s, catalog.LABEL, 5) if not f["skipped"]]
    folds = fit.fit_side_by_side(s, {str(q): F.col("_q_idx") < q for q in live}, catalog.LABEL)
    out = {"train": json.loads(jobs.fit_model(s).to_json()),
           "folds": {f"{int(q) // 4}Q{int(q) % 4 + 1}": json.loads(m.to_json()) for q, m in folds.items()}}
    with open(os.path.join(ROOT, "oracle", "fitted_sf0.01.json"), "w", encoding="utf-8") as f:
        json.dump(out, f, indent=0)


if __name__ == "__main__":
    main(*sys.argv[1:])
