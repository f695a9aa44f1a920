"""The fluent block query: filters that are AND-ed, seven projected columns, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def translation_status(policy: Column, translated: Column, source: Column) -> Column:
    """preserved where the policy says no; pending without a translation or with an unchanged one; else done."""
    return F.when(~F.coalesce(policy, F.lit(True)), "preserved").when(F.coalesce(translated, F.lit("")) == "", "pending").when(translated == source, "pending").otherwise("done")


def effective_confidence(confidence: Column) -> Column:
    """A missing confidence counts as 1, and so does 0."""
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(1.0))


class DocumentQuery:
    """Query over blocks ``(doc_id, block_idx, text, kind, ...)``; each call narrows it."""

    def __init__(self, blocks: DataFrame):
        self._kinds: tuple[str, ...] | None = None
        self._blocks, self._tests = blocks, []

    def kind(self, *kinds: str) -> DocumentQuery:
        self._kinds = kinds  # the last call wins
        return self

    def page(self, number: int) -> DocumentQuery:
        return self.where(F.col("doc_id") == number)

    def where(self, test: Column) -> DocumentQuery:
        self._tests.append(test)
        return self

    def translated(self, status: str = "done") -> DocumentQuery:
        return self.where(F.col("status") == status)

    def confidence_below(self, limit: float) -> DocumentQuery:
        return self.where(effective_confidence(F.col("confidence")) < limit)

    def has_replacement(self, flag: bool = True) -> DocumentQuery:
        found = F.contains("text", F.lit("�")) | F.col("text").rlike(r"\(cid:[0-9]+\)")
        return self.where(found if flag else ~found)

    def frame(self) -> DataFrame:
        out = self._blocks
        if self._kinds:
            out = out.where(F.col("kind").isin(*self._kinds))
        for t in self._tests:
            out = out.where(t)
        return out

    def execute(self) -> DataFrame:
        """The seven columns of each block, text cut to 120 characters for display, in reading order."""
        have = set(self._blocks.columns)
        conf = F.col("confidence") if "confidence" in have else F.lit(None).cast("double")
        status = F.col("status") if "status" in have else F.lit("pending")
        return self.frame().select(
            F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("_"), F.col("block_idx").cast("string")).alias("id"),
            F.col("doc_id").alias("page"),
            F.col("block_idx").cast("bigint").alias("idx"),
            "kind",
            F.substring("text", 1, 120).alias("text"),
            conf.alias("confidence"),
            status.alias("status"),
        ).orderBy("page", "idx")

    def ids(self) -> DataFrame:
        return self.execute().select("id")

    def count(self) -> int:
        return self.frame().count()


def find_text(blocks: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """Blocks that hold ``needle``."""
    text, wanted = (F.col("text"), needle) if case_sensitive else (F.lower("text"), needle.lower())
    return blocks.where(F.contains(text, F.lit(wanted)))
