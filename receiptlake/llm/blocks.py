"""All pairs within a group, a pair of blocks at a time.

Rows come sorted by (key, i, j): those of one pair of blocks of one group stand together,
with ``mine`` telling the block of each. No group is ever held as a whole.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd


def _begins(batch: pd.DataFrame, key: str) -> np.ndarray:
    new = np.zeros(len(batch) + 1, dtype=bool)
    new[[0, -1]] = True
    for column in (key, "i", "j"):
        values = batch[column].to_numpy()
        new[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole pairs of blocks, with the places where these begin and the end."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if rest:
            last = rest[-1].iloc[-1]
            first = batch.iloc[0]
            if all(last[c] == first[c] for c in (key, "i", "j")):
                begins = _begins(batch, key)
                if len(begins) == 2:  # still the same pair of blocks
                    rest.append(batch)
                    continue
            batch = pd.concat([*rest, batch], ignore_index=True)
        begins = _begins(batch, key)
        if len(begins) > 2:
            cut = begins[-2]
            yield batch.iloc[:cut], begins[:-1]
            batch = batch.iloc[cut:].reset_index(drop=True)
        rest = [batch] if len(batch) else []
    if rest:
        batch = pd.concat(rest, ignore_index=True)
        yield batch, _begins(batch, key)


def connecting(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that connect what a symmetric matrix links, one less than rows per component."""
    a, b = [], []
    waiting = near.any(axis=1)
    while waiting.any():
        open_ = [int(waiting.argmax())]
        waiting[open_[0]] = False
        while open_:
            x = open_.pop()
            reached = np.flatnonzero(near[x] & waiting)
            waiting[reached] = False
            a += [x] * len(reached)
            b += reached.tolist()
            open_ += b[len(b) - len(reached) :]
    return a, b
