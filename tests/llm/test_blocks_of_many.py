"""op7: a node moves for a bounded number of blocks, and large groups in a tile are put together."""

import numpy as np
import pyarrow as pa

from loopweave.llm import embedding_dedup as E


def test_blocks_grow_before_they_become_many():
    for n in (100, 5000, 98_304, 200_000, 600_000, 1_500_000):
        rows = E.block_rows(n, 64)
        assert -(-n // rows) <= 24 and rows * 64 * 8 <= E.BLOCK_BYTES
    assert E.block_rows(50_000, 64) == 4096 and E.block_rows(10**6, 64, 40) == 40


def test_groups_of_a_tile():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 400)] + 0.07 * rng.normal(size=(400, 16))).astype(np.float32)
    names = [f"n{k:03d}" for k in rng.permutation(400)]
    table = pa.table({"node": names, "size": pa.array(np.ones(400, np.int64)), "side": pa.array(np.full(400, 2, np.int32)), "vector": pa.array(list(x), pa.list_(pa.float32()))})
    got = {r["node"]: (r["other"], r["links"]) for r in E._tile(table).to_pylist()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    near = (d @ d.T >= E.THRESHOLD) & ~np.eye(400, dtype=bool)
    reach = near | np.eye(400, dtype=bool)
    for _ in range(9):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = {names[k]: (min(names[j] for j in np.flatnonzero(reach[k])), int(near[k].sum())) for k in range(400) if near[k].any()}
    assert got == want
