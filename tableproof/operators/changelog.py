"""Batches of changes in levels over a base table, folded into the base as they add up.

A batch is stored as one row per key, its last change. ``fanout`` folders of one level merge into one
of the next, and when the changes reach a share of the base they are folded into it, so a reader meets
at most ``fanout - 1`` folders a level however many batches came. Folders are never changed. A manifest names the
live ones and is replaced as a whole: until then readers see the table before the batch, and a batch
that failed anywhere is simply applied again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, functions as F

from tableproof.operators.merge import keys_match
from tableproof.session import materialize

_MANIFEST = "version bigint, last bigint, base string, base_rows bigint, levels array<struct<level: int, folder: string, rows: bigint>>"


class ChangeLog:
    """``base`` with numbered batches of I/U/D changes applied, in a folder that driver and executors share.

    The result is that of ``delta_apply`` with all batches at once: the change with the greatest sequence number
    decides, whichever batch brought it. Folded keys keep their last change, deletions included, so a
    late change never undoes a newer one. The log has one writer. Folders that neither manifest slot names belong to
    failed or merged batches; the folder's owner removes them once no reader is left.
    """

    def __init__(
        self, base: DataFrame, path: str, keys: Sequence[str], op_col: str, seq_col: str, fanout: int = 4, fold_at: float = 0.25
    ):
        self.base, self.path, self.keys = base, path.rstrip("/"), list(keys)
        self.op_col, self.seq_col, self.fanout, self.fold_at = op_col, seq_col, fanout, fold_at
        self.spark = base.sparkSession
        self.values = [c for c in base.columns if c not in keys]

    # --- manifest -----------------------------------------------------------

    def manifest(self) -> Row:
        """The newest published state. Versions take turns in two slots, so one is whole while the other is written."""
        found = [Row(version=-1, last=-1, base=None, base_rows=None, levels=[])]
        for slot in (0, 1):
            try:
                found += self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest-{slot}").collect()
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
        return max(found, key=lambda row: row["version"])

    def _publish(self, state: Row) -> None:
        one = self.spark.createDataFrame([tuple(state)], _MANIFEST).coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.path}/manifest-{state['version'] % 2}")

    # --- folders ------------------------------------------------------------

    def _change(self, applied: int, seq: Column, op: Column) -> Column:
        """What orders the changes of a key: any change comes behind the base row."""
        return F.struct(F.lit(applied).alias("applied"), seq.alias("seq"), op.alias("op"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(self.values)]).alias("__change")

    def _last(self, changes: DataFrame) -> DataFrame:
        """One row per key; ``max`` combines on the map side, so a hot key costs one row per task."""
        return changes.groupBy(*self.keys).agg(F.max("__change").alias("__change"))

    def _store(self, rows: DataFrame, level: int) -> Row:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{folder}")
        return Row(level=level, folder=folder, rows=self._read(folder, rows).count())

    def _read(self, folder: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{folder}")

    def _base(self, state: Row, changes: DataFrame | None = None) -> DataFrame:
        # Sequence and operation take the types that the changes have.
        types = {f.name: f.dataType for f in changes.schema["__change"].dataType.fields} if changes is not None else {"seq": "bigint", "op": "string"}
        rows = self.base.select(*self.keys, self._change(0, F.lit(None).cast(types["seq"]), F.lit(None).cast(types["op"])))
        return rows if state["base"] is None else self._read(state["base"], rows)

    def _changes(self, levels: Sequence[Row]) -> DataFrame | None:
        if not levels:
            return None
        return self._last(reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{x['folder']}") for x in levels]))

    def _applied(self, state: Row, changes: DataFrame) -> DataFrame:
        """Base and changes, one row per changed key; the changes are written first, so that few are sent to the base."""
        new = materialize(changes, "changes")
        base = self._base(state, new)
        late = new.select(*self.keys, F.col("__change").alias("__new"))
        newer = F.greatest("__change", "__new")
        both = base.join(late, keys_match(base, late, self.keys), "left").where(F.col("__new").isNull() | (F.col("__change.applied") == 1))
        kept = both.select(*[base[k] for k in self.keys], newer.alias("__change"))
        settled = base.where("__change.applied = 1").select(*self.keys)
        wanted = new.select(*self.keys)
        settled = settled.join(wanted, keys_match(settled, wanted, self.keys), "left_semi")
        return kept.unionByName(new.join(settled, keys_match(new, settled, self.keys), "left_anti"))

    # --- use ----------------------------------------------------------------

    def append(self, batch: DataFrame, number: int) -> None:
        """Take in a batch. Numbers ascend; a batch whose number is in already is left alone."""
        state = self.manifest()
        if number <= state["last"]:
            return
        levels, base, base_rows = list(state["levels"]), state["base"], state["base_rows"]
        if base_rows is None:
            base_rows = self.base.count()
        stored = self._store(self._last(batch.select(*self.keys, self._change(1, F.col(self.seq_col), F.col(self.op_col)))), 0)
        if stored["rows"]:
            levels.append(stored)
        level = 0
        while len(full := [x for x in levels if x["level"] == level]) >= self.fanout:
            merged = self._store(self._changes(full), level + 1)
            levels = [x for x in levels if x["level"] != level] + [merged]
            level += 1
        if levels and sum(x["rows"] for x in levels) >= self.fold_at * base_rows:
            folded = self._store(self._applied(state, self._changes(levels)), -1)
            levels, base, base_rows = [], folded["folder"], folded["rows"]
        self._publish(Row(version=state["version"] + 1, last=number, base=base, base_rows=base_rows, levels=levels))

    def table(self) -> DataFrame:
        """The table after the last published batch; a log without changes is the base."""
        state = self.manifest()
        changes = self._changes(state["levels"])
        if changes is not None:
            rows = self._applied(state, changes)
        elif state["base"] is not None:
            rows = self.spark.read.parquet(f"{self.path}/{state['base']}")
        else:
            return self.base
        live = rows.where((F.col("__change.applied") == 0) | (F.col("__change.op") != "D"))
        values = {c: F.col(f"__change.v{i}").alias(c) for i, c in enumerate(self.values)}
        return live.select(*[values.get(c, F.col(c)) for c in self.base.columns])
