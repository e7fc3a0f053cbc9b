"""Gap editing: a log of keys folded over an alignment.

Sessions (session_id, aligned1, aligned2) and keys (session_id, seq_no, key).
Keys: ArrowLeft, ArrowRight, ArrowUp, ArrowDown and Tab, '-' and ' ', Delete,
Backspace, and Reset, which brings back the original strings and the first
place. The result of a key depends on all before it, so a session's keys meet
in one partition, sorted there, and are folded as they stream by: a task holds
one session's strings and a batch of keys, never a log. A key costs the same
however long the strings are.

Results at the edges: null strings are empty; unknown and null keys count but
change nothing; keys with a null seq_no come first, ties go by the key; keys of
no session, or of a null one, are left out; sessions without keys, and those
with a null id, come back tidied; repeated sessions each get all the keys.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import chars, col
from ..params import Linear
from .align import global_alignment
from .scoring import linear_score

GAP_KEYS, REMOVE_KEYS = ("-", " "), ("Delete", "Backspace")
RESET = "Reset"
STATE = "aligned1 string, aligned2 string, cursor long, active long, n_keys long"
NAMES = ["session_id", "aligned1", "aligned2", "cursor", "active", "n_keys"]


class Editor:
    """Two rows, each cut at the cursor into what is left and what is right of it.

    The rows are tidy at any time: of equal length, without columns of gaps
    alone at the ends (if there is any letter at all).
    """

    def __init__(self, rows: list[str | None], cursor: int = 0, active: int = 0, original: list[str | None] | None = None):
        rows = [r or "" for r in rows]
        self.original = [r or "" for r in original] if original else rows
        self.load(rows, cursor)
        self.active = active

    def load(self, rows: list[str], cursor: int) -> None:
        width = max(map(len, rows))
        self.lettered = any(r.strip("-") for r in rows)
        self.left = [deque(r.ljust(width, "-")[:cursor]) for r in rows]
        self.right = [deque(r.ljust(width, "-")[cursor:]) for r in rows]
        self.tidy()

    @property
    def cursor(self) -> int:
        return len(self.left[0])

    @property
    def rows(self) -> list[str]:
        return ["".join(x) + "".join(y) for x, y in zip(self.left, self.right)]

    def press(self, key: str | None) -> None:
        left, right, other = self.left[self.active], self.right[self.active], 1 - self.active
        if key == "ArrowLeft" and left:
            for x, y in zip(self.left, self.right):
                y.appendleft(x.pop())
        elif key == "ArrowRight" and right:
            for x, y in zip(self.left, self.right):
                x.append(y.popleft())
        elif key in ("ArrowUp", "ArrowDown", "Tab"):
            self.active = {"ArrowUp": 0, "ArrowDown": 1, "Tab": other}[key]
        elif key == RESET:
            self.load(self.original, 0)
            self.active = 0
        elif key in GAP_KEYS:
            left.append("-")
            self.right[other].append("-")
            self.left[other].append(self.right[other].popleft())
            self.tidy()
        elif key == "Delete" and right and right[0] == "-":
            right.popleft()
            right.append("-")
            self.tidy()
        elif key == "Backspace" and (left[-1] if left else right[0] if right else "") == "-":
            if left:
                left.pop()
                self.right[other].appendleft(self.left[other].pop())
            else:
                right.popleft()
            right.append("-")
            self.tidy()

    def tidy(self) -> None:
        """Columns of gaps alone go at both ends; the cursor moves with what it stands on."""
        if self.lettered:
            while all((x or y)[0] == "-" for x, y in zip(self.left, self.right)):
                for x, y in zip(self.left, self.right):
                    (x or y).popleft()
            while all((y or x)[-1] == "-" for x, y in zip(self.left, self.right)):
                for x, y in zip(self.left, self.right):
                    (y or x).pop()


def fold(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """The state of each session after its keys."""
    texts = [F.lit(None).cast("string").alias(c) for c in ("aligned1", "aligned2")]
    starts = sessions.select("session_id", F.lit(False).alias("is_key"), F.lit(None).alias("seq_no"), F.lit(None).cast("string").alias("key"), "aligned1", "aligned2")
    rows = starts.unionAll(keys.filter("session_id is not null").select("session_id", F.lit(True).alias("is_key"), "seq_no", "key", *texts))
    place = F.when(F.col("session_id").isNull(), F.xxhash64("aligned1", "aligned2")).otherwise(F.xxhash64("session_id"))
    rows = rows.repartition(place).sortWithinPartitions("session_id", "is_key", "seq_no", "key")
    spec = f"session_id {dict(rows.dtypes)['session_id']}, {STATE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, editors, pressed, done = None, [], 0, []

        def end() -> None:
            done.extend((now, *e.rows, e.cursor, e.active + 1, pressed) for e in editors)

        def told(ids: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done)
            kinds = (ids, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], NAMES)

        ids = None
        for batch in batches:
            ids = batch.schema.field("session_id").type
            for session, is_key, key, a, b in zip(*(batch.column(c).to_pylist() for c in ("session_id", "is_key", "key", "aligned1", "aligned2"))):
                if session != now or session is None:
                    end()
                    now, editors, pressed = session, [], 0
                if not is_key:
                    editors.append(Editor([a, b]))
                elif editors:
                    pressed += 1
                    for e in editors:
                        e.press(key)
            if done:
                yield told(ids)
                done.clear()
        end()
        if done:
            yield told(ids)

    return rows.drop("seq_no").mapInArrow(run, spec)


def scored(folded: DataFrame, p: Linear = Linear()) -> DataFrame:
    """``folded`` with the score after the edits, the optimum of the strings without gaps, and what the optimum would gain."""
    rows = folded.withColumn("score", linear_score("aligned1", "aligned2", p).total_score)
    best = global_alignment(F.replace("aligned1", F.lit("-"), F.lit("")), F.replace("aligned2", F.lit("-"), F.lit("")), p).score
    return rows.withColumn("optimum", best).withColumn("improvement", F.col("optimum") - F.col("score"))


def normalised(a: Column | str, b: Column | str) -> Column:
    """struct<aligned1, aligned2>: padded to one length."""
    n = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.struct(F.rpad(col(a), n, "-").alias("aligned1"), F.rpad(col(b), n, "-").alias("aligned2"))


def without_gap_columns(a: Column | str, b: Column | str) -> Column:
    """struct<aligned1, aligned2, removed>: columns of gaps alone are taken out."""
    pairs = F.arrays_zip(chars(a).alias("x"), chars(b).alias("y"))
    kept = F.filter(pairs, lambda r: ~((r.x == "-") & (r.y == "-")))
    join = lambda f: F.array_join(F.transform(kept, f), "")
    return F.struct(join(lambda r: r.x).alias("aligned1"), join(lambda r: r.y).alias("aligned2"), (F.size(pairs) - F.size(kept)).cast("long").alias("removed"))
