"""Frames of many animations as a stream: reference slots and counters carried from frame to frame.

The state of a file is five frame numbers and two counters, whatever its length. It goes when the file's last frame has
been seen, or, with `patience`, when none has come for so long. Frames of a file must arrive in the order of their numbers; within a
batch they are sorted, and one that comes after a later one is an error, since what was given out can't be taken back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "file long, n long, ref_0 long, ref_1 long, ref_2 long, ref_3 long, visible long, invisible long"
STATE = "ref_0 long, ref_1 long, ref_2 long, ref_3 long, visible long, invisible long, last long"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, patience: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    *refs, visible, invisible, last = state.get if state.exists else (None, None, None, None, 0, 0, None)
    frames = pd.concat(batches).sort_values("n")
    if last is not None and frames["n"].iloc[0] <= last:
        raise ValueError(f"frame {frames['n'].iloc[0]} of file {key[0]} came after frame {last}")
    last = int(frames["n"].iloc[-1])
    rows, ended = [], False
    for f in frames.itertuples():
        if f.presented:
            visible, invisible = visible + 1, 0
        else:
            invisible += 1
        rows.append((key[0], f.n, *refs, visible, invisible))
        if f.is_reference:
            refs[f.save_as] = f.n
        ended |= bool(f.is_last)
    if ended:
        state.remove()
    else:
        state.update((*refs, visible, invisible, last))
        if patience:
            state.setTimeoutDuration(patience)
    yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")]).astype("Int64")


def follow(frames: DataFrame, patience: int | None = None) -> DataFrame:
    """frames: file, n, is_reference, save_as (0-3), presented, is_last; a stream.

    patience: milliseconds without a frame after which a file is forgotten. It is looked at in every trigger, so a
    query that ends when its input does (availableNow) must go without.
    """
    kept = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    return frames.groupBy("file").applyInPandasWithState(partial(fold, patience=patience), OUT, STATE, "append", kept)
