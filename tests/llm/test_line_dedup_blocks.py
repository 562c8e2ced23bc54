import random

import numpy as np
import test_line_dedup as base

from duewise.llm import line_dedup as ld
from duewise.llm.common import Workspace


def test_blocks_allow_every_pair_within_the_distance():
    rng = random.Random(7)
    for n in (8, 31, 32, 33, 63, 64, 65, 127, 130, 258):
        for _ in range(40):
            x = "".join(rng.choice("abcdefg ") for _ in range(n))
            lines = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (x, base.edited(rng, x, 2))]
            lines.sort(key=len)
            less = len(lines[1]) - len(lines[0])
            # The shorter line's length is the indexed one.
            a, b = (m.tolist() for m in (ld.block_counts(lines)[0, 0], ld.block_counts(lines)[1, less]))
            for p, q in zip(a, b, strict=True):
                changes = [abs((p >> 4 * k & 15) - (q >> 4 * k & 15)) for k in range(8)]
                assert sum(min(d, 16 - d) for d in changes) <= 4


class Counted(Workspace):
    """Notes the rows of each staged table."""

    def stage(self, df, name, compression="snappy"):
        out = super().stage(df, name, compression)
        self.rows = {**getattr(self, "rows", {}), name: out.count()}
        return out


def test_variants_too_far_apart_make_few_pairs(spark):
    """Variants of one length and with the same letters, an inserted word apart, share thirds but do not link."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    lines = sorted({line[:i] + word + line[i:] for i in range(2, 398, 4) for word in ("zxqv", "vqxz")})
    lines += [lines[0][:50] + "#" + lines[0][51:]]
    ws = Counted(spark, "t")
    got = ld.near_groups(spark.createDataFrame(list(enumerate(lines)), "number long, line string"), ws).collect()
    assert {r.node for r in got} == {0, len(lines) - 1} and len({r.component for r in got}) == 1
    # Letter counts of whole lines alone leave 15 210.
    assert ws.rows["pairs-rest"] < 6000
