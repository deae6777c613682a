"""Participant counters by buckets of addresses."""

import pandas as pd

from linkweave.streaming.participants import NO_BLOCK, Counters


class _State:
    """A value state in memory that counts its updates."""

    def __init__(self):
        self.value, self.updates = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1


def test_a_bucket_of_many_addresses_is_one_update_a_batch():
    counters = Counters(3)
    counters.state = _State()
    frame = lambda rows: pd.DataFrame(rows, columns=["address", "first_block", "n", "bucket"])
    many = [(f"x{n}", 2**60 + n, 2, 7) for n in range(10_000)]
    first = pd.concat(counters.handleInputRows((7,), iter([frame(many), frame([("x5", 4, 9, 7), (None, NO_BLOCK, 1, 7)])]), None))
    second = pd.concat(counters.handleInputRows((7,), iter([frame([("x5", 9, 1, 7), ("x6", 3, 1, 7), (None, NO_BLOCK, 1, 7)])]), None))
    assert counters.state.updates == 2 and len(first) == 10_001
    assert {tuple(r) for r in first[first["crossed"]].itertuples(index=False)} == {("x5", 4, 11, True)}
    assert {tuple(r) for r in second.itertuples(index=False)} == {("x5", 4, 12, False), ("x6", 3, 3, True), (None, NO_BLOCK, 2, False)}
    assert first.set_index("address").loc["x9", "first_block"] == 2**60 + 9
