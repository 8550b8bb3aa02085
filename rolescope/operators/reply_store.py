"""Replies of models, kept by content: a prompt that was answered once is never sent again.

Below ``path`` stand the replies in folders by ``part`` of the key, a hash of model name and prompt. New prompts are reduced to
distinct ones and sent in rounds; each round is written before the next begins, so a run that is stopped has lost one round at most, and the next run
sends what is still missing. Prompts without a reply are not kept and are sent again by the next run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BATCH_SIZE
from ..session import stored
from .extract import Model, extracted_fields, model_replies, prompted, retrying

_ROWS = "key string, reply string, part int"


@dataclass(frozen=True)
class ReplyStore:
    """The replies at ``path``. ``per_round`` prompts are sent between two writes, by ``parallelism`` tasks, which keeps the model
    from being asked by more tasks than it bears. One writer at a time."""

    spark: SparkSession
    path: str
    model_name: str
    parts: int = 64
    per_round: int = 100_000
    parallelism: int = 64
    call_size: int = BATCH_SIZE

    def key(self, prompt: Column) -> Column:
        """A hash of model name and prompt; NULL for no prompt."""
        return F.sha2(F.concat(F.lit(f"{self.model_name}\0"), prompt), 256)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        """All kept replies: ``key, reply, part``, each key once."""
        try:
            return self.spark.read.schema(_ROWS).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _ROWS)

    def ask(self, prompts: DataFrame, model: Model, prompt: str = "_prompt", same: str | None = None) -> None:
        """Send those prompts of a column that have no reply yet, each distinct one once.

        ``same`` names a column whose equal values share a reply, such as a normalized description: of their prompts the smallest is
        sent, and the reply is kept under the value.
        """
        value = F.col(same or prompt)
        asked = prompts.where(F.col(prompt).isNotNull()).groupBy(self.key(value).alias("key")).agg(F.min(prompt).alias("prompt"))
        known = self.read().select("key", "part")
        missing = stored(asked.where("key IS NOT NULL").withColumn("part", self._part()).join(known, ["key", "part"], "left_anti"), "asked")
        rounds = -(-missing.count() // self.per_round)
        for number in range(rounds):
            # Rounds are cut by the key, so they hold about as many prompts each and do not depend on how the rows lie.
            own = missing.where(F.pmod(F.xxhash64("key", F.lit("round")), F.lit(rounds)) == number).repartition(self.parallelism)
            replied = own.select("key", model_replies(F.col("prompt"), retrying(model), self.call_size).alias("reply"), "part")
            replied.where("reply IS NOT NULL").write.mode("append").partitionBy("part").parquet(self.path)

    def replies(self, prompts: DataFrame, prompt: str = "_prompt", same: str | None = None) -> DataFrame:
        """The rows with the kept ``_reply`` to each prompt, NULL if there is none. Hot prompts are split by the join."""
        keyed = prompts.withColumn("key", F.when(F.col(prompt).isNotNull(), self.key(F.col(same or prompt))))
        kept = self.read().select("key", F.col("reply").alias("_reply"))
        return keyed.join(kept, "key", "left").drop("key")


def extract_stored(postings: DataFrame, model: Model, store: ReplyStore, same: Column | None = None) -> DataFrame:
    """``extract_jobs`` by way of a store: the model sees each distinct prompt once over all runs.

    ``same`` is an expression over the postings, with descriptions cut to the prompt's length, of which those with equal values share one extraction: postings of one text in many
    places, for example, by ``normalized_text()``. Asks at once; the fields are read lazily from the store.
    """
    asked = prompted(postings)
    if same is not None:
        asked = asked.withColumn("_same", F.coalesce(same, F.col("_prompt")))
    name = None if same is None else "_same"
    store.ask(asked, model, same=name)
    return extracted_fields(store.replies(asked, same=name), postings.columns)


def normalized_text(title: str = "title", description: str = "description") -> Column:
    """Title and description in lower case, with white space and punctuation folded: equal for re-posted adverts. NULL texts are empty."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" \n "), F.coalesce(description, F.lit("")))
    return F.trim(F.regexp_replace(F.lower(both), r"[\s\p{Punct}]+", " "))
