"""Folds over sequences that may be endless: worked on in blocks, with the result of one pass.

A block is folded from the state that some rows before it suggest. Where that isn't the state which the block
before really ends in, the block is folded again from the right one, in rounds, until every block begins as its
predecessor ends. A block keeps what it gave under each state it was begun with, so blocks that never fall into
step with each other need no more rounds than they have states; where a state is carried through many blocks, ever
longer chains of them are folded in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import cut

#: Positions per block of a long sequence, and how many before it suggest its state.
BLOCK, WARM_UP = 4096, 160


class Machine:
    """What a fold does with a row: `feed` gives output rows, `rest` those that the end of the sequence adds, `state` all
    that later rows depend on as text, and `resume` goes on from there."""

    def feed(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def rest(self) -> list[tuple]:
        return []

    def state(self) -> str:
        raise NotImplementedError

    def resume(self, state: str) -> None:
        raise NotImplementedError


def _run(make: Callable[[], Machine], key: str, n_columns: int, kinds: list[pa.DataType], names: list[str], least: int = 2000):
    """Rows sorted by (key, chain, block, order) to outputs of their blocks and a row per block with the states around it.
    The blocks of a chain are folded one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, machine, began = None, None, make(), None
        out: list[tuple] = []
        blank = (None,) * len(kinds)
        digest = lambda state: hashlib.md5(state.encode()).hexdigest()

        def ended() -> str:
            state = machine.state()
            if began is not None:
                out.extend((now[0], at, began, True, None, None, *row) for row in machine.rest())
                out.append((now[0], at, began, None, state, digest(state), *blank))
            return state

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), *kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "_b", "_in", "_tail", "_state", "_out", *names])

        for batch in batches:
            keys, chains, blocks, core, given = (batch.column(k).to_pylist() for k in range(5))
            rows = zip(*(batch.column(5 + k).to_pylist() for k in range(n_columns)))
            for k, chain, b, own, start, row in zip(keys, chains, blocks, core, given, rows):
                if (k, chain) != now:
                    ended()
                    now, at, machine, began = (k, chain), b, make(), None
                elif b != at:
                    state, machine = ended(), make()
                    machine.resume(state)
                    at, began = b, None
                if start is not None:
                    machine.resume(start)
                    continue
                if own and began is None:
                    began = digest(machine.state())
                for x in machine.feed(row):
                    if own:
                        out.append((k, b, began, False, None, None, *x))
            if len(out) >= least:
                yield batch_of()
                out = []
        ended()
        if out:
            yield batch_of()

    return run


def _walk(key: str, far: int):
    """A row per block: the state it begins with as far as that is known. Blocks that lack theirs begin a chain of at
    most `far` blocks, which are folded from there."""

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        memo: dict[int, dict[str, str]] = {}
        guess: dict[int, str] = {}
        for b, i, o, first in zip(f["_b"], f["_in"], f["_out"], f["_first"]):
            memo.setdefault(b, {})[i] = o
            if first:
                guess[b] = i
        rows, now, chain, left = [], None, None, 0
        order = sorted(memo)
        for n, b in enumerate(order):
            s = guess[b] if n == 0 else now
            lacks = s not in memo[b]
            chain, left = (b, far) if lacks else (chain, left)
            rows.append((f[key].iloc[0], b, guess[b] if lacks else s, lacks, chain if left > 0 else None, order[n - 1] if n else None, rows[-1][2] if n else None, b == order[-1]))
            left -= 1
            now = memo[b][guess[b] if lacks else s]
        return pd.DataFrame(rows, columns=[key, "_b", "_in", "_lacks", "_chain", "_pb", "_pin", "_last"]).astype({"_chain": "Int64", "_pb": "Int64"})

    return walk


def fold(rows: DataFrame, key: str, position: str, columns: list[str], make: Callable[[], Machine], schema: str, block: int = BLOCK, warm_up: int = WARM_UP) -> DataFrame:
    """(key, schema): what a machine gives for each key's rows in order of `columns`, as in one pass over them.

    key is a string and position an integer column, neither null; columns are those that the machine is fed, position first. Rows of a
    block come in the order of all columns that can be ordered by.
    """
    fields = StructType.fromDDL(schema)
    names = [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    full = f"{key} string, _b bigint, _in string, _tail boolean, _state string, _out string, {schema}"
    own, at = F.floor(F.col(position) / F.lit(block)), F.pmod(position, F.lit(block))
    types = dict(rows.dtypes)
    ordered = [c for c in columns if not types[c].startswith(("array", "map"))]
    nothing = F.lit(None).cast("string").alias("_given")
    seen = F.array_compact(F.array(own, F.when(at >= block - warm_up, own + 1)))
    warm = rows.select(key, F.explode(seen).alias("_b"), own.alias("_own"), nothing, *columns).select(key, F.col("_b").alias("_chain"), "_b", (F.col("_b") == F.col("_own")).alias("_core"), "_given", *columns)
    base = rows.select(key, own.alias("_b"), F.lit(True).alias("_core"), nothing, *columns)

    def run(df: DataFrame) -> DataFrame:
        placed = df.repartition(key, "_chain").sortWithinPartitions(key, "_chain", "_b", F.col("_given").isNull(), *ordered)
        return placed.mapInArrow(_run(make, key, len(columns), kinds, names), full)

    parts = [cut(run(warm))]
    states = parts[0].where("_out is not null").select(key, "_b", "_in", "_out", F.lit(True).alias("_first"))
    long = states.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    steps = f"{key} string, _b bigint, _in string, _lacks boolean, _chain bigint, _pb bigint, _pin string, _last boolean"
    far = 1
    while True:
        walked = cut(states.join(long, key, "left_semi").groupBy(key).applyInPandas(_walk(key, far), steps))
        lacking = walked.where("_lacks")
        if lacking.isEmpty():
            break
        if far > 2**40:
            raise RuntimeError("a machine that was resumed is in another state than it was resumed from")
        ends = _union(parts).where("_out is not null").select(key, F.col("_b").alias("_pb"), F.col("_in").alias("_pin"), "_state")
        start = lacking.select(key, "_chain", "_b", "_pb", "_pin").join(ends, [key, "_pb", "_pin"]).select(key, "_chain", "_b", F.lit(False).alias("_core"), F.col("_state").alias("_given"), *[F.lit(None).cast(types[c]).alias(c) for c in columns])
        again = base.join(walked.where("_chain is not null").select(key, "_b", "_chain"), [key, "_b"]).select(start.columns)
        # Where a chain meets a state that its block was begun with before, that is known already.
        parts.append(cut(run(again.unionByName(start)).join(states.select(key, "_b", "_in"), [key, "_b", "_in"], "left_anti").select(key, "_b", "_in", "_tail", "_state", "_out", *names)))
        states = states.unionByName(parts[-1].where("_out is not null").select(key, "_b", "_in", "_out", F.lit(False).alias("_first")))
        far = 1 if len(parts) < 4 else far * 16
    found = _union(parts).where("_out is null")
    # Almost every block is right at once, so only what isn't is looked for.
    wrong = states.select(key, "_b", "_in").join(walked.select(key, "_b", F.col("_in").alias("_right")), [key, "_b"]).where("_in <> _right").select(key, "_b", "_in")
    found = found.join(wrong, [key, "_b", "_in"], "left_anti")
    tails = found.where("_tail").join(walked.where("not _last").select(key, "_b"), [key, "_b"], "left_anti")
    return found.where("not _tail").select(key, *names).unionByName(tails.select(key, *names))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
