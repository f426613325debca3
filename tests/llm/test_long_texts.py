import random

import pyarrow as pa

from factloom.llm import fingerprints


def test_shift_beyond_a_mebibyte():
    """A long text that reappears behind another head is a near copy, however far its anchors lie."""
    r = random.Random(5)
    body = " ".join(f"b{r.randrange(10**9)}" for _ in range(150_000))
    head = " ".join(f"h{r.randrange(10**9)}" for _ in range(50_000)) + " "
    assert len(body) > 3 << 19
    a, b = fingerprints.fingerprints(pa.array([body, head + body], pa.large_string()))
    assert max(b["place"]) > 65535
    assert fingerprints.likeness(a, b) > 0.7
    assert fingerprints.likeness(a, fingerprints.from_string(fingerprints.as_string(a))) == 1.0
