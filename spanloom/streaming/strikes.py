"""Two-strike trust as a stream: keyed state instead of a window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "identity string, trusted_at long"
STATE = "pending int, trusted int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, trusted = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    out = []
    for outcome, seq in zip(rows["outcome"], rows["seq"], strict=True):
        if trusted:
            break
        if outcome == "success":
            pending = 0
        elif outcome == "failure":
            pending += 1
            if pending == 2:
                trusted = 1
                out.append((key[0], int(seq)))
    state.update((pending, trusted))
    yield pd.DataFrame(out, columns=["identity", "trusted_at"])


def two_strike_stream(attempts: DataFrame) -> DataFrame:
    """Identities at the moment they become trusted, from a stream of (identity, seq, outcome).

    The state of a key is two numbers; other outcomes are neutral. Rows of one
    micro-batch are ordered by seq; batches must arrive in order per identity.
    """
    return attempts.groupBy("identity").applyInPandasWithState(_advance, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
