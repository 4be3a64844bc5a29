"""State machines over the ordered rows of a key, run block by block.

A state machine looks sequential, yet each one used here has a short description of what a whole
block does to any incoming state. So every block is described on its own, and each block is then replayed
from its true starting state. Descriptions are maps from state to state and compose, so runs of ``FAN`` blocks are
described by one map, runs of those again, and the states at the starts come back down the same tree: no task
reads more than ``FAN`` descriptions of a key. Only keys with more than one block need all that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.operators.timeline import BLOCK, INDEX, prefix
from secflow.settings import block_rows, checkpointed

ENTRY = "_entry"
#: Descriptions that are composed, or walked, in one group.
FAN = 64


def fold_rows(df: DataFrame, groups: Sequence[str], order: Sequence[str], inputs: Sequence[str],
              step: Callable, start: object, keep: Sequence[str], outputs: dict[str, str],
              entry: str | None = None) -> DataFrame:
    """Pass a state through the ordered rows of each group, streaming Arrow batches.

    ``step(state, *inputs)`` returns (state, values) or (state, None) to leave the row out. Rows are
    placed by group and sorted inside the partitions, so a task holds one batch at a time and small
    groups cost nothing extra.
    """
    groups, inputs, keep, names = list(groups), list(inputs), list(keep), list(outputs)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{n}` {d}" for n, d in outputs.items()])

    def run(batches):
        last, state = None, start
        for pdf in batches:
            ids = list(zip(*[pdf[c].tolist() for c in groups]))
            entries = pdf[entry].tolist() if entry else None
            kept, made = [], []
            for i, values in enumerate(zip(*[pdf[c].tolist() for c in inputs])):
                if ids[i] != last:
                    last, state = ids[i], start
                    if entries is not None and entries[i] is not None and entries[i] == entries[i]:
                        state = entries[i]
                state, out = step(state, *values)
                if out is not None:
                    kept.append(i)
                    made.append(out)
            result = pdf.iloc[kept][keep].reset_index(drop=True)
            for j, name in enumerate(names):
                result[name] = [m[j] for m in made]
            yield result

    placed = df.repartition(*groups).sortWithinPartitions(*groups, *order)
    return placed.mapInPandas(run, ddl)


def block_scan(df: DataFrame, keys: Sequence[str], *, inputs: Sequence[str], step: Callable, start: float,
               keep: Sequence[str], outputs: dict[str, str],
               describe: Callable[[pd.DataFrame], list], advance: Callable[[float, list], float],
               index: str = INDEX, block: int | None = None,
               compose: Callable[[list, list], list],
               widen: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a state machine over ``df`` (which carries the position column ``index``).

    step:     (state, *inputs) -> (state after the row, output values or None)
    describe: rows of a block -> list of doubles that describes the block's effect
    advance:  (state, description) -> state after the block
    compose:  (description, description of the block behind) -> description of both
    widen:    adds columns that only ``describe`` reads
    """
    keys = list(keys)
    size = block or block_rows(df.sparkSession)
    # Read up to three times below, so it is computed once and kept in the shared folder.
    rows = checkpointed(df.withColumn(BLOCK, F.expr(f"{index} div {size}")))
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    scan = dict(groups=[*keys, BLOCK], order=[index], inputs=inputs, step=step, start=start, keep=keep,
                outputs=outputs)

    spanning_keys = rows.where(F.col(BLOCK) > 0).select(*keys)
    if spanning_keys.isEmpty():
        return fold_rows(rows, **scan)

    spanning = rows.join(spanning_keys.distinct(), keys, "left_semi")
    if widen is not None:
        spanning = widen(spanning, size)

    def describe_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, BLOCK: [pdf[BLOCK].iloc[0]],
                             "_effect": [[float(v) for v in describe(pdf)]]})

    effects = (spanning.groupBy(*keys, BLOCK)
               .applyInPandas(describe_block, f"{key_ddl}, {BLOCK} bigint, _effect array<double>"))
    entries = entry_states(effects, keys, advance, compose, start, key_ddl)
    return fold_rows(rows.join(entries, [*keys, BLOCK], "left"), entry=ENTRY, **scan)


def entry_states(effects: DataFrame, keys: list[str], advance: Callable, compose: Callable, start: float,
                 key_ddl: str) -> DataFrame:
    """keys, BLOCK and ENTRY, the state at the start of each block, by a tree over the blocks of a key."""
    fan = FAN
    above = F.expr(f"{BLOCK} div {fan}")

    def join_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        whole = list(pdf["_effect"].iloc[0])
        for effect in pdf["_effect"].iloc[1:]:
            whole = compose(whole, list(effect))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, BLOCK: [pdf[BLOCK].iloc[0] // fan],
                             "_effect": [[float(v) for v in whole]]})

    levels = [checkpointed(effects)]
    blocks = levels[0].agg(F.max(BLOCK)).first()[0] + 1
    while blocks > fan:
        levels.append(checkpointed(levels[-1].withColumn("_above", above).groupBy(*keys, "_above").applyInPandas(
            lambda pdf: join_runs(pdf.drop(columns="_above")), f"{key_ddl}, {BLOCK} bigint, _effect array<double>")))
        blocks = -(-blocks // fan)
    entries = None
    for level in reversed(levels):
        rows = level.withColumn("_above", above)
        if entries is not None:
            rows = rows.join(entries.withColumnRenamed(BLOCK, "_above"), [*keys, "_above"])
        entries = fold_rows(rows, [*keys, "_above"], [BLOCK], ["_effect"],
                            lambda state, effect: (advance(state, effect), (state,)), start, [*keys, BLOCK],
                            {ENTRY: "double"} if entries is None else {"_at": "double"},
                            entry=None if entries is None else ENTRY)
        entries = entries.withColumnRenamed("_at", ENTRY) if "_at" in entries.columns else entries
    return entries


def greedy_select(df: DataFrame, keys: Sequence[str], position: str, resume: str,
                  carry: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Keep the chain of rows that a left-to-right scan picks.

    The scan takes the first row, skips everything before that row's ``resume`` position, takes the
    next row, and so on. Rows are those that could be picked; ``resume`` is greater than
    ``position``. The result holds ``keys``, ``position`` and ``carry`` of the picked rows.
    """

    def with_reach(rows: DataFrame, size: int) -> DataFrame:
        return prefix(rows, keys, [F.col(position)], F.expr(f"{position} div {size}"),
                      {"_reach": ("max", F.col(resume))})

    def describe(pdf: pd.DataFrame) -> list:
        pos, res = pdf[position].to_numpy(), pdf[resume].to_numpy().astype(float)
        nxt = np.searchsorted(pos, res, side="left")
        out = res.copy()
        for i in range(len(pos) - 1, -1, -1):
            if nxt[i] < len(pos):
                out[i] = out[nxt[i]]
        # An earlier block can send the scan no further than its largest resume position, so
        # only the rows up to there, and the first one after it, can be entry points.
        reach = pdf["_reach"].iloc[0]
        reach = -1.0 if pd.isna(reach) else float(reach)
        last = int(np.searchsorted(pos, reach, side="left"))
        return [reach, *(float(v) for pair in zip(pos[: last + 1], out[: last + 1]) for v in pair)]

    def advance(state: float, effect: list) -> float:
        pairs = np.asarray(effect[1:], dtype=float).reshape(-1, 2)
        at = np.searchsorted(pairs[:, 0], state, side="left")
        return float(pairs[at, 1]) if at < len(pairs) else state

    def compose(first: list, then: list) -> list:
        """Entries of the first block lead on through the second; entries behind its rows go straight to the second."""
        own, behind = (np.asarray(e[1:], dtype=float).reshape(-1, 2) for e in (first, then))
        whole = [(p, advance(o, then)) for p, o in own]
        if own[-1, 0] < first[0]:
            more = behind[behind[:, 0] > own[-1, 0]]
            whole += more[: int(np.searchsorted(more[:, 0], first[0], side="left")) + 1].tolist()
        return [first[0], *(float(v) for pair in whole for v in pair)]

    def step(state: float, pos: int, res: int):
        return (float(res), ()) if pos >= state else (state, None)

    return block_scan(df, keys, inputs=[position, resume], step=step, start=-1.0,
                      keep=[*keys, position, *[c for c in carry if c not in keys]], outputs={},
                      describe=describe, advance=advance, compose=compose, index=position, block=block,
                      widen=with_reach)
