"""The dataset object."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from airrline.names import BARCODE, LOCUS, RECEPTOR, REPERTOIRE, c
from airrline.schema import ReceptorSchema, as_receptor_schema

Lazy = DataFrame | Callable[[], DataFrame]


class AirrData:
    """Chain-level annotations with receptor ids, and optionally a table of repertoires.

    Every operation returns a new object. ``annotations`` and
    ``repertoire_table`` may be given as functions, which run when the frame is
    first asked for; making ids starts jobs then. ``facts``, if known, are the
    chains with their counts but no ids: what counting needs, where a receptor is
    a tuple of features.
    """

    def __init__(self, schema_receptor, annotations: Lazy, repertoire_table: Lazy | None = None, schema_repertoire: Sequence[str] = (), facts: DataFrame | None = None):
        self.schema_receptor: ReceptorSchema = as_receptor_schema(schema_receptor)
        self.schema_repertoire = tuple(schema_repertoire)
        self.facts = facts
        self._annotations, self._table = annotations, repertoire_table

    @property
    def annotations(self) -> DataFrame:
        if not isinstance(self._annotations, DataFrame):
            self._annotations = self._annotations()
        return self._annotations

    @property
    def repertoire_table(self) -> DataFrame | None:
        """The table of repertoires, in any order; None before ``agg_repertoires``."""
        if self._table is not None and not isinstance(self._table, DataFrame):
            self._table = self._table()
        return self._table

    def over(self, annotations: DataFrame, keep_repertoires: bool = False) -> AirrData:
        """The same receptors over other rows, with the table of repertoires as it is or without."""
        if keep_repertoires:
            return AirrData(self.schema_receptor, annotations, self._table, self.schema_repertoire)
        return AirrData(self.schema_receptor, annotations)

    @property
    def repertoires(self) -> DataFrame | None:
        """The table of repertoires by id; None before ``agg_repertoires``."""
        return None if self.repertoire_table is None else self.repertoire_table.orderBy(REPERTOIRE)

    @property
    def receptors(self) -> DataFrame:
        """A row for each receptor; for paired receptors, each pairing of the two loci in a cell.

        In the paired view, features and locus carry ``.x`` for the first and
        ``.y`` for the second locus.
        """
        features, chains = self.schema_receptor.features, self.schema_receptor.chains
        if len(chains) != 2:
            return self.annotations.select(c(RECEPTOR), *[c(f) for f in features]).dropDuplicates([RECEPTOR])
        both = [*features, *([LOCUS] if LOCUS not in features else [])]

        def side(locus: str, end: str) -> DataFrame:
            rows = self.annotations.filter(c(LOCUS) == locus)
            return rows.select(c(RECEPTOR).alias("r" + end), c(BARCODE).alias("b" + end), *[c(f).alias(f + end) for f in both])

        x, y = side(chains[0], ".x"), side(chains[1], ".y")
        same = c("r.x").eqNullSafe(c("r.y")) & c("b.x").eqNullSafe(c("b.y"))
        out = x.join(y, same, "full_outer")
        ids = [F.coalesce(c("r.x"), c("r.y")).alias(RECEPTOR), F.coalesce(c("b.x"), c("b.y")).alias(BARCODE)]
        return out.select(*ids, *[c(f + ".x") for f in both], *[c(f + ".y") for f in both])

    def count(self) -> DataFrame:
        """One row: the number of chains, as ``n``."""
        return self.annotations.agg(F.count("*").alias("n"))

    def filter(self, *conditions, seq_options=None, keep_repertoires: bool = True) -> AirrData:
        from airrline.operators.filters import filter_data

        return filter_data(self, *conditions, seq_options=seq_options, keep_repertoires=keep_repertoires)

    def mutate(self, seq_options=None, **columns) -> AirrData:
        from airrline.operators.mutate import mutate_data

        return mutate_data(self, seq_options=seq_options, **columns)

    def describe(self, n: int = 10) -> str:
        """Text with the first rows of each table, and the schemas."""
        parts = [f"Receptor features: {', '.join(self.schema_receptor.features)}; chains: {', '.join(self.schema_receptor.chains) or 'any'}"]
        parts += ["Receptors:", _head(self.receptors, n), "Annotations:", _head(self.annotations, n)]
        if self.repertoire_table is not None:
            parts += [f"Repertoire columns: {', '.join(self.schema_repertoire)}", "Repertoires:", _head(self.repertoires, n)]
        return "\n".join(parts)

    def print(self, n: int = 10) -> AirrData:
        print(self.describe(n))
        return self


def _head(df: DataFrame, n: int) -> str:
    rows = df.limit(n).collect()
    return "\n".join(["\t".join(df.columns), *["\t".join(map(str, r)) for r in rows]])
