"""Rounds of a step over state.

Every round reads the state that the round before left, so rounds are supersteps. A bound of staleness is accepted,
and met: a round never reads anything older.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from keyfold import storage


def iterate(
    state: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    rounds: int,
    until: Callable[[DataFrame, DataFrame], bool] | None = None,
    checkpoint_every: int = 5,
    checkpoint_path: str | None = None,
    staleness: int = 0,
) -> DataFrame:
    """The state after so many rounds, or once `until` holds of the states before and after one.

    States between checkpoints are kept, spilling to disk, and computed when one is read: without `until`, the rounds up
    to a checkpoint are stages of one job. Every checkpoint_every rounds the state is written to the checkpoint folder,
    which cuts lineage, and to checkpoint_path/cp-n if that is given. The last state is always written, and nothing is
    kept in the end.
    """
    if rounds < 0 or staleness < 0:
        raise ValueError("rounds and staleness aren't negative")
    held: list[DataFrame] = []
    written = True
    for n in range(1, rounds + 1):
        before, state, written = state, step(state, n), False
        if checkpoint_every and n % checkpoint_every == 0:
            state, written = storage.cut(state), True
            if checkpoint_path:
                storage.save(state, f"{checkpoint_path}/cp-{n // checkpoint_every}")
            for df in held:
                df.unpersist()
            held = []
        elif n < rounds or until is not None:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
        if until is not None:
            state.count()
            if until(before, state):
                break
            if len(held) > 2:  # those before have been read by now
                held.pop(0).unpersist()
    if not written:
        state = storage.cut(state)
    for df in held:
        df.unpersist()
    return state


def resume(spark, step: Callable[[DataFrame, int], DataFrame], rounds: int, checkpoint_every: int, checkpoint_path: str, start: Callable[[], DataFrame]) -> DataFrame:
    """Goes on from the last complete snapshot under checkpoint_path, or from the start without one."""
    found = storage.versions(spark, checkpoint_path)
    done = found[-1] * checkpoint_every if found else 0
    state = storage.load(spark, f"{checkpoint_path}/cp-{found[-1]}") if found else start()
    shifted = lambda df, n: step(df, n + done)
    return iterate(state, shifted, max(0, rounds - done), checkpoint_every=checkpoint_every)


def repeated(state: DataFrame | None, fold: Callable[[DataFrame | None], DataFrame], rounds: int) -> DataFrame | None:
    """The same messages folded in again each round."""
    for _ in range(rounds):
        state = fold(state)
    return state
