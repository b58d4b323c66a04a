"""Questions that a model or a person answers (UDF-01 to UDF-03), as functions from a DataFrame to a DataFrame.

Every chain takes such a function and has a rule of its own for a default, which needs no network. asked_of() makes one of a
client: it is built once for each partition, on the executor, and gets whole batches.
"""

import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.functions.text import MOVE_ENDS, ends_sentence

Step = Callable[[DataFrame], DataFrame]


def asked_of(make_client: Callable[[], Callable[[pd.DataFrame], pd.Series]], name: str, kind: str) -> Step:
    """A step that adds the column `name`: what the client answers to each batch of rows."""

    def step(df: DataFrame) -> DataFrame:
        def run(batches):
            client = make_client()
            for batch in batches:
                yield batch.assign(**{name: client(batch)})

        schema = StructType(list(df.schema.fields)).add(name, kind)
        return df.mapInPandas(run, schema)

    return step


def goes_on(text: Column, gap_ms: Column, glue_ms: int) -> Column:
    """Whether a text is followed by more of it: it doesn't end a sentence and the gap is short."""
    return ~ends_sentence(text, MOVE_ENDS, ()) & (gap_ms < glue_ms)


def rule_judge(borders: DataFrame, *, glue_ms: int = 1500) -> DataFrame:
    """UDF-01: same, for borders(left_text, right_text, gap_ms, context)."""
    return borders.withColumn("same", goes_on(F.col("left_text"), F.col("gap_ms"), glue_ms))


def rule_span_judge(spans: DataFrame) -> DataFrame:
    """UDF-01 for glued spans(left_text, ...): approved if the text before the change of label doesn't end a sentence."""
    return spans.withColumn("approved", ~ends_sentence(F.col("left_text"), MOVE_ENDS, ()))


def rule_verifier(proposals: DataFrame) -> DataFrame:
    """UDF-02: approved unless the earlier one of target and first anchor ends a sentence; proposals: run_index, anchors, target_text, anchor_texts, context."""
    earlier = F.when(F.get("anchors", F.lit(0)) < F.col("run_index"), F.get("anchor_texts", F.lit(0))).otherwise(F.col("target_text"))
    return proposals.withColumn("approved", ~ends_sentence(earlier, MOVE_ENDS, ()))


def kept_as_is(lines: DataFrame) -> DataFrame:
    """UDF-03: the text itself for its translation."""
    return lines.withColumn("text_ko", F.col("text"))


class Busy(Exception):
    """What a client raises if the same question may be answered later: too many requests, a failing server, no answer in time. Any exception with `again` set will do."""

    again = True


#: How often a question is asked at most, and seconds before the second time; each later pause is twice as long.
ATTEMPTS, PAUSE_S = 3, 1.0
_REPLY = "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>"


def reply_text(reply: Column) -> Column:
    """FN-23: the text of a reply document: its output_text, else the texts of its outputs' contents, one after the other; null if it has none or isn't JSON."""
    r = F.from_json(reply, _REPLY)
    contents = F.flatten(F.transform(F.coalesce(r["output"], F.array()), lambda o: F.coalesce(o["content"], F.array())))
    texts = F.array_compact(F.transform(contents, lambda c: F.when(F.coalesce(c["type"], F.lit("output_text")) == "output_text", c["text"])))
    return F.coalesce(F.nullif(r["output_text"], F.lit("")), F.nullif(F.array_join(texts, ""), F.lit("")))


def strict_fault(text: Column, fields: dict[str, str | tuple[str, ...]]) -> Column:
    """FN-23, UDF-04: what is wrong with an answer, or null: it has to be a JSON object of exactly these fields, each of its type (boolean, string, bigint, double) or one of its choices."""
    v = F.try_parse_json(text)
    fault = F.when(v.isNull() | (F.json_object_keys(text).isNull()), "no JSON object")
    extra = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, fields)))
    for name, kind in fields.items():
        got = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        here = F.array_contains(F.json_object_keys(text), name)
        fault = fault.when(~here, f"{name} is missing")
        if isinstance(kind, tuple):
            fault = fault.when(~F.coalesce((got == "STRING") & F.try_variant_get(v, f"$.{name}", "string").isin(*kind), F.lit(False)), f"{name} is none of its choices")
        else:
            fits = got.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") if kind == "double" else got == kind.upper()
            fault = fault.when(~F.coalesce(fits, F.lit(False)), f"{name} is no {kind}")
    return fault.when(F.size(extra) > 0, F.concat(F.lit("unasked: "), F.array_join(extra, ", ")))


def _asked(prompts: DataFrame, make_client: Callable[[], Callable[[str], str]], attempts: int, pause_s: float) -> DataFrame:
    """prompts: key, prompt. key, reply, attempts and error, each asked by a client of its partition, again after a growing pause while it is Busy."""

    def run(batches):
        client = make_client()
        for b in batches:
            rows = []
            for prompt in b.column(1).to_pylist():
                reply, error = None, None
                for k in range(attempts):
                    try:
                        reply, error = client(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001 what one question meets is no reason to end the others
                        # by the attribute: a worker can have the class twice, pickled and imported
                        if not getattr(e, "again", False):
                            error = f"{type(e).__name__}: {e}"
                            break
                        error = f"busy: {e}"
                        if k + 1 < attempts:
                            time.sleep(pause_s * 2**k)
                rows.append((reply, k + 1, error))
            reply, tries, error = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(reply, pa.string()), pa.array(tries, pa.int32()), pa.array(error, pa.string())], names=["key", "reply", "attempts", "error"])

    return prompts.select("key", "prompt").mapInArrow(run, "key string, reply string, attempts int, error string")


def strictly_asked(
    questions: DataFrame, prompt: Column, fields: dict[str, str | tuple[str, ...]], make_client: Callable[[], Callable[[str], str]], cache: str, *, name: str = "answer",
    attempts: int = ATTEMPTS, pause_s: float = PAUSE_S, rounds: int = 1, partitions: int = 8,
) -> DataFrame:
    """UDF-05 with UDF-04 and FN-23: questions with the struct `name` of the fields, and name_error, why there is none. No failure ends the job.

    A client takes a prompt and gives a reply document. Equal prompts are asked once. Replies go to the Parquet table `cache`, in a folder that the cluster shares, by a
    hash of prompt and fields, and what is there with a sound answer isn't asked again, in this job or a later one; faults are, the next time. `rounds` parts are asked and
    written one after the other: a job that ends early, or a task that is tried again, repeats at most its own part. `partitions` clients ask at a time.
    """
    spark = questions.sparkSession
    known = "key string, reply string, attempts int, error string"
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    read = lambda: spark.read.schema(known).parquet(cache) if there.exists(path) else spark.createDataFrame([], known)
    key = F.sha2(F.concat_ws("|", F.lit(repr(sorted(fields.items()))), prompt), 256)
    keyed = questions.withColumns({"__prompt": prompt, "__key": F.when(prompt.isNotNull(), key)})
    wanted = keyed.filter("__prompt is not null").select(F.col("__key").alias("key"), F.col("__prompt").alias("prompt")).dropDuplicates(["key"])
    fault = F.coalesce("error", F.when(reply_text(F.col("reply")).isNull(), "no text"), strict_fault(reply_text(F.col("reply")), fields))
    for k in range(rounds):
        part = wanted.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        fresh = part.join(read().filter(fault.isNull()).select("key"), "key", "left_anti").repartition(partitions, "key")
        _asked(fresh, make_client, attempts, pause_s).write.mode("append").parquet(cache)
    # of several replies to a prompt a sound one counts
    answered = read().withColumn("__fault", fault).groupBy("key").agg(F.min_by(F.struct("reply", "__fault"), F.struct(F.col("__fault").isNotNull(), "reply")).alias("__r"))
    v = F.try_parse_json(reply_text(F.col("__r.reply")))
    value = F.struct(*[F.try_variant_get(v, f"$.{f}", "string" if isinstance(kind, tuple) else kind).alias(f) for f, kind in fields.items()])
    done = keyed.join(answered.withColumnRenamed("key", "__key"), "__key", "left")
    error = F.when(F.col("__prompt").isNull(), "no prompt").otherwise(F.col("__r.__fault"))
    return done.withColumns({name: F.when(error.isNull(), value), f"{name}_error": error}).drop("__prompt", "__key", "__r")


def choice(options: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """UDF-04: the fields of a question with one answer out of options."""
    return {"choice": tuple(options)}


#: UDF-01, UDF-02: the one field of a yes-or-no question.
YES_OR_NO = {"answer": "boolean"}


def strict_judge(make_client, cache: str, column: str, prompt: Column, **how) -> Step:
    """A judge or a verifier over strictly_asked(): adds the boolean `column`; what couldn't be asked counts as no, with the reason in `column`_error."""

    def step(rows: DataFrame) -> DataFrame:
        done = strictly_asked(rows, prompt, YES_OR_NO, make_client, cache, name="__yes", **how)
        return done.withColumns({column: F.coalesce(F.col("__yes.answer"), F.lit(False)), f"{column}_error": F.col("__yes_error")}).drop("__yes", "__yes_error")

    return step
