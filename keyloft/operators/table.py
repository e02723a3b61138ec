"""A schemaless table: keys as columns, typed views, materialized columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vmap import VMAP, maplookup, normalize_vmap, pair, value_text
from .inference import cast_to, classed, pickbesttyperesult, type_name

RAW = "__raw__"
#: Columns that a view or a materialized table has at most.
MOST_COLUMNS = 10_000


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class LooseTable:
    """Rows with a vmap in ``__raw__`` and, possibly, real columns beside it.

    A name resolves to a real column if there is one, in any ASCII case, and to a
    lookup in the map otherwise; so materialized keys are read as ordinary columns,
    with pruning and pushdown, and unknown keys are null.
    """

    def __init__(self, df: DataFrame, name: str = "t"):
        if RAW not in df.columns:
            raise ValueError(f"the table has no column {RAW}")
        self.df, self.name = df, name

    @classmethod
    def empty(cls, spark, name: str = "t") -> LooseTable:
        return cls(spark.createDataFrame([], f"{RAW} {VMAP}"), name)

    def col(self, key: str) -> Column:
        real = {c.lower(): c for c in self.df.columns}
        return quoted(real[key.lower()]) if key.lower() in real else maplookup(F.col(RAW), key)

    def select(self, *keys: str) -> DataFrame:
        return self.df.select(*[self.col(k).alias(k) for k in keys])

    def where(self, condition: Column) -> LooseTable:
        return LooseTable(self.df.filter(condition), self.name)

    def append(self, rows: DataFrame) -> LooseTable:
        """Add loaded rows; columns that one side lacks are null there."""
        return LooseTable(self.df.unionByName(rows, allowMissingColumns=True), self.name)

    def insert(self, rows: DataFrame) -> LooseTable:
        """Insert rows of named columns into the map; real columns are filled as well."""
        kinds = dict(rows.dtypes)
        pairs = F.array(*[pair(F.lit(c), value_text(quoted(c), kinds[c])) for c in rows.columns])
        made = rows.select(normalize_vmap(F.filter(pairs, lambda p: p["value"].isNotNull())).alias(RAW))
        filled = [self.df.schema[c] for c in self.df.columns if c != RAW and not c.startswith("__")]
        for field in filled:
            made = made.withColumn(field.name, maplookup(F.col(RAW), field.name).try_cast(field.dataType))
        return self.append(made)

    def keys(self) -> DataFrame:
        """``key_name``, ``frequency`` and ``data_type_guess`` of every key.

        Frequency counts pairs, those with a null value too.  Pairs are classed
        and counted before they are shuffled.
        """
        each = self.df.select(F.explode(RAW).alias("p"))
        counted = classed(each, F.col("p.value"), F.col("p.key").alias("key_name"), is_map=F.col("p.is_map"))
        guess = type_name(pickbesttyperesult(F.col("_c")))
        return counted.select("key_name", F.col("_c.rows").alias("frequency"), guess.alias("data_type_guess"))

    def _listed(self, keys: DataFrame | None, n: int | None = None) -> list[tuple[str, str]]:
        """Keys with their types, most frequent first; more than ``MOST_COLUMNS`` of them are no columns."""
        ordered = (keys or self.keys()).orderBy(F.desc("frequency"), "key_name")
        rows = ordered.limit(MOST_COLUMNS + 1 if n is None else n).collect()
        if len(rows) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} keys: name those that are to be columns")
        seen: dict[str, tuple[str, str]] = {}
        for r in rows:
            seen.setdefault(r["key_name"].lower(), (r["key_name"], r["data_type_guess"]))
        return list(seen.values())

    def view(self, keys: DataFrame | None = None, name: str | None = None) -> DataFrame:
        """A column of the guessed type for every key; registered as ``<name>_view``."""
        df = self.df.select(*[cast_to(self.col(k).cast("string"), t).alias(k) for k, t in self._listed(keys)])
        df.createOrReplaceTempView(name or f"{self.name}_view")
        return df

    def materialize(self, n: int = 50, keys: DataFrame | None = None) -> tuple[LooseTable, DataFrame]:
        """Make the ``n`` most frequent keys real columns; also returns what became of each."""
        df, told = self.df, []
        for key, guess in self._listed(keys, n):
            if key.lower() in {c.lower() for c in df.columns}:
                told.append((key, "EXISTS", "Column of same name already exists"))
            else:
                df = df.withColumn(key, cast_to(maplookup(F.col(RAW), key), guess))
                told.append((key, "ADDED", "Added successfully"))
        return LooseTable(df, self.name), df.sparkSession.createDataFrame(told, "key_name string, status string, message string")
