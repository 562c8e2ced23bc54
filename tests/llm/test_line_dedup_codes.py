import numpy as np
import pyarrow as pa

from duewise.llm import line_dedup as ld


def test_code_points_of_a_batch():
    lines = ["plain line", "", "naïve café", "𝄞 and 漢字", "end"]
    for part in (lines, lines[:2], lines[1:2], ["a" * 70, "b"]):
        for batch in (pa.array(part), pa.array(["é!", *part, "z"])[1:-1]):
            got = ld._all_code_points(batch)
            assert [x.tolist() for x in got] == [[ord(c) for c in t] for t in part]


def test_keys_do_not_depend_on_other_lines():
    """A line has the same keys beside lines of code points above the table as alone."""
    a, b = (np.array([ord(c) for c in t], np.uint32) for t in ("an ordinary line of more than thirty letters", "漢字" * 20))
    both = ld.segment_keys([a, b])
    for i, x in enumerate((a, b)):
        alone = ld.segment_keys([x.astype(np.uint8) if x.max() < 128 else x])
        assert all((p[0] == q[i]).all() for p, q in zip(alone, both, strict=True))
