"""Time plain numpy and pandas forms of a few jobs on the same rows, as a yardstick.

    python tools/single_node.py [folder]
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb
import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskspark.operators.thresholds import threshold_grid  # noqa: E402
from workload.views import with_views  # noqa: E402


def load(folder: str):
    db = duckdb.connect()
    for name in ("orders", "customer"):
        path = f"{folder}/{name}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    scored = db.execute(with_views("SELECT y_true, p1 FROM scored", "scored")).df()
    loans = db.execute(with_views("SELECT issue_ts, loan_amnt, dti, emp_length FROM loans", "loans")).df()
    return scored, loans


def sweep(scored):
    y, p = scored["y_true"].to_numpy(), scored["p1"].to_numpy()
    rows = []
    for t in threshold_grid():
        hit = p >= t
        tp, fp = int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum())
        rows.append((t, tp, fp, int((y == 1).sum()) - tp, int((y == 0).sum()) - fp))
    return rows


def auc(scored):
    y, p = scored["y_true"].to_numpy(), scored["p1"].to_numpy()
    values, place = np.unique(p, return_inverse=True)
    pos = np.bincount(place, weights=y == 1, minlength=len(values))
    neg = np.bincount(place, weights=y == 0, minlength=len(values))
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pos.sum() / neg.sum())


def encode_by_value(loans):
    known = np.array(sorted(loans["emp_length"].fillna("missing").unique()))
    return loans["emp_length"].fillna("missing").apply(
        lambda v: int(np.searchsorted(known, v)) if v in known else -1
    )


def ks(loans):
    early = loans["issue_ts"] < "1998-07-01"
    a = np.sort(loans.loc[early, "loan_amnt"].to_numpy())
    b = np.sort(loans.loc[~early, "loan_amnt"].to_numpy())
    points = np.concatenate([a, b])
    gap = np.searchsorted(a, points, "right") / len(a) - np.searchsorted(b, points, "right") / len(b)
    return float(np.abs(gap).max())


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    start = time.perf_counter()
    scored, loans = load(folder)
    seconds = {"load": round(time.perf_counter() - start, 3)}
    jobs = {
        "threshold_sweep_80_passes": lambda: sweep(scored),
        "roc_auc": lambda: auc(scored),
        "encode_one_column_by_value": lambda: encode_by_value(loans),
        "ks_one_column": lambda: ks(loans),
        "median_two_columns": lambda: loans[["loan_amnt", "dti"]].median(),
    }
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"rows": len(scored), "seconds": seconds}))


if __name__ == "__main__":
    main()
