"""Oracles generated token by token: beam search over a back-off n-gram model.

The model is a table: each context (up to order - 1 tokens) with the tokens that follow it most often and their log shares, in
whole thousandths, so that sums are exact and equal scores are equal. A beam takes the longest of its last contexts that the
model knows, at BACKOFF for every token left out. The model is never gathered: a step joins the last contexts of all live beams
with it and keeps the best beams of each prompt. What a prompt generates hangs on its last tokens alone, so each distinct end
is worked on once, however many rows share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

END = "</s>"
BEAMS, MAX_NEW, ORDER, BACKOFF = 5, 14, 3, -917
#: Steps between two checkpoints.
STEPS_AT_ONCE = 3
NEXT = "array<struct<token: string, score: bigint>>"


def _ends(prompt: Column, order: int) -> Column:
    """The last order - 1 tokens of a prompt; none of a null."""
    p = F.coalesce(prompt, F.array().cast("array<string>"))
    n = F.least(F.size(p), F.lit(order - 1))
    return F.when(n > 0, F.slice(p, F.size(p) - n + 1, n)).otherwise(F.array().cast("array<string>"))


def train(df: DataFrame, prompt: str = "prompt", output: str = "output", order: int = ORDER, beams: int = BEAMS) -> DataFrame:
    """The model of rows with a prompt and an output, arrays of tokens without white space: context (tokens joined by blanks, ''
    for none), size (how many), next (the `beams` most frequent tokens, of equal ones the least, with their scores). Outputs
    end with END; null arrays are empty. Counts are summed before and after one shuffle, and a context's tokens are cut to
    the best before its group comes together."""
    d = df.select(_ends(F.col(prompt), order).alias("p"), F.concat(F.coalesce(output, F.array().cast("array<string>")), F.array(F.lit(END))).alias("o"))
    d = d.select(F.concat("p", "o").alias("s"), F.explode(F.sequence(F.size("p") + 1, F.size("p") + F.size("o"))).alias("j"))
    sizes = F.sequence(F.lit(0), F.least(F.lit(order - 1), F.col("j") - 1))
    d = d.select("s", "j", F.explode(sizes).alias("size")).select("size", F.array_join(F.slice("s", F.col("j") - F.col("size"), F.col("size")), " ").alias("context"), F.get("s", F.col("j") - 1).alias("token"))
    d = d.groupBy("context", "size", "token").agg(F.count("*").alias("n"))
    total = d.groupBy("context", "size").agg(F.sum("n").alias("total"))
    first = Window.partitionBy("context", "size").orderBy(F.desc("n"), "token")
    d = d.withColumn("k", F.row_number().over(first)).where(F.col("k") <= beams).join(total, ["context", "size"])
    score = F.floor(1000.0 * F.log(F.col("n").cast("double") / F.col("total").cast("double")))
    return cut(d.groupBy("context", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token", score.alias("score")))), lambda x: F.struct(x["token"].alias("token"), x["score"].alias("score"))).alias("next")))


def _step(beams: DataFrame, model: DataFrame, shortest: Column, order: int, width: int) -> DataFrame:
    """One token more for every live beam, and the best `width` of each start."""
    live, done = beams.where("not done"), beams.where("done")
    sizes = F.sequence(F.lit(1), F.size("last"))
    asked = live.where(F.size("last") > 0).select("start", "tokens", F.col("last").alias("l"), F.explode(sizes).alias("size"))
    asked = asked.withColumn("context", F.array_join(F.slice("l", F.size("l") - F.col("size") + 1, F.col("size")), " ")).drop("l")
    known = asked.join(model, ["context", "size"]).groupBy("start", "tokens").agg(F.max_by(F.struct("size", "next"), "size").alias("m"))
    d = live.join(known, ["start", "tokens"], "left")
    d = d.select("start", "tokens", "last", "score", F.coalesce("m.size", F.lit(0)).alias("size"), F.explode(F.coalesce("m.next", shortest)).alias("x"))
    last = F.concat("last", F.array("x.token"))
    grown = d.select(
        "start", F.when(F.col("tokens") == "", F.col("x.token")).otherwise(F.concat_ws(" ", "tokens", "x.token")).alias("tokens"),
        F.slice(last, F.greatest(F.lit(1), F.size(last) - (order - 2)), order - 1).alias("last"),
        (F.col("score") + F.col("x.score") + BACKOFF * (F.size("last") - F.col("size"))).alias("score"), (F.col("x.token") == END).alias("done"),
    )
    best = Window.partitionBy("start").orderBy(F.desc("score"), "tokens")
    return grown.unionByName(done).withColumn("k", F.row_number().over(best)).where(F.col("k") <= width).drop("k")


def generate(df: DataFrame, model: DataFrame, id_col: str = "id", prompt: str = "prompt", beams: int = BEAMS, max_new: int = MAX_NEW, order: int = ORDER) -> DataFrame:
    """id, rank (1 the best), output (tokens joined by blanks, without END), score: the beams of each row that ended, or are
    max_new tokens long, by their sum of log shares over their number of tokens, of equal ones by tokens. While beams grow they
    are kept by their sums, ended ones among them. Ids need not be distinct. An empty model gives empty outputs of score 0."""
    rows = df.select(F.col(id_col).alias("id"), F.array_join(_ends(F.col(prompt), order), " ").alias("start"), _ends(F.col(prompt), order).alias("last"))
    shortest = model.where("size = 0").select("next").first()
    shortest = F.array(*[F.struct(F.lit(x["token"]).alias("token"), F.lit(x["score"]).cast("bigint").alias("score")) for x in shortest["next"]]) if shortest else F.array(F.struct(F.lit(END).alias("token"), F.lit(0).cast("bigint").alias("score")))
    b = cut(rows.select("start", "last").dropDuplicates(["start"]).select("start", F.lit("").alias("tokens"), "last", F.lit(0).cast("bigint").alias("score"), F.lit(False).alias("done")))
    for k in range(max_new):
        b = _step(b, model, shortest, order, beams)
        if k % STEPS_AT_ONCE == STEPS_AT_ONCE - 1 or k == max_new - 1:
            b = cut(b)
            if b.where("not done").isEmpty():
                break
    size = F.size(F.split("tokens", " ")).cast("double")
    b = b.select("start", F.regexp_replace("tokens", rf"(^| ){END}$", "").alias("output"), (F.col("score").cast("double") / size).alias("score"))
    b = b.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "output")))
    return rows.select("id", "start").join(b, "start").select("id", "rank", "output", "score")


def predict_by_generation(df: DataFrame, model: DataFrame, out: str = "prediction", prompt: str = "prompt", **options: int) -> DataFrame:
    """df with the best beam of each row's prompt. The ends of prompts meet it again, so rows need no id."""
    order = options.get("order", ORDER)
    end = F.array_join(_ends(F.col(prompt), order), " ")
    starts = df.select(end.alias("_start"), F.col(prompt).alias("prompt")).dropDuplicates(["_start"])
    best = generate(starts, model, "_start", "prompt", **options).where("rank = 1").select(F.col("id").alias("_start"), F.col("output").alias(out))
    return df.withColumn("_start", end).join(best, "_start").drop("_start")
