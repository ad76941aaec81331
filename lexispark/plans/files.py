"""Queries that write a table in the form of a source, read it back by that form's reader and return what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.sequences import _shared_folder
from ..sources import readers, writers
from .core import norm, query, table


def _place(spark) -> str:
    _shared_folder(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query("select doc_id, lang, source, text from documents")
def sc9_manifest(spark, d):
    at = _place(spark)
    writers.manifest(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), at, "doc_id")
    return readers.manifest(spark, at, "doc_id long, lang string, source string, text string", "doc_id")


_FLAT = "nullif(regexp_replace(coalesce(text, ''), '[\\t\\r\\n]', ' ', 'g'), '')"


@query(f"select cast(doc_id as varchar) as id, {_FLAT} as text, source from documents")
def sc10_tsv(spark, d):
    """Texts without tabs and line ends as tab-separated fields; quotes are ordinary signs."""
    at = _place(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.regexp_replace("text", "[\t\r\n]", " ").alias("text"), "source")
    plain = {"sep": "\t", "quote": "\0", "header": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(**plain).csv(at)
    return readers.tsv(spark, at, ["id", "text", "source"])


@query("select page_id, url as audio_path from pages")
def sc11_nested_field(spark, d):
    at = _place(spark)
    table(spark, d, "pages").select("page_id", F.struct(F.col("url").alias("path"), F.col("html").cast("binary").alias("bytes")).alias("audio")).write.parquet(at)
    return readers.nested(spark, at, "page_id", "audio.path")


@query("select doc_id as id, source as label from documents")
def sc12_records(spark, d):
    """A JSON object of up to a hundred records a file."""
    at = _place(spark)
    docs = table(spark, d, "documents").withColumn("block", F.expr("doc_id div 100"))
    docs.groupBy("block").agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("label"))).alias("records")).write.partitionBy("block").json(at)
    return readers.records(spark, at, "id long, label string")


@query("select p_brand || ' ' || p_partkey as f0, p_name as f1 from part")
def sc13_rule_tables(spark, d):
    """Rules with comments and blank lines between them."""
    at = _place(spark)
    lines = F.explode(F.array(F.concat(F.lit("# "), F.col("p_name")), F.concat_ws("\t", F.concat_ws(" ", "p_brand", "p_partkey"), "p_name"), F.lit("")))
    table(spark, d, "part").select(lines.alias("value")).write.text(at)
    return readers.rules(spark, at, 2)


def _joined(field: str) -> str:
    return f"trim(regexp_replace({field}, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


_BLOCKS = """(select conv_id // 10 as block, string_agg('Turn ' || turn || ' of ' || conv_id || '.', '{0}' order by conv_id, turn) as text from conversations group by 1)"""


def _turns(spark, d):
    """(block, lines): the turns of ten conversations as short lines in order."""
    said = F.concat(F.lit("Turn "), "turn", F.lit(" of "), "conv_id", F.lit("."))
    turns = table(spark, d, "conversations").select(F.expr("conv_id div 10").alias("block"), F.struct("conv_id", "turn", said.alias("said")).alias("x"))
    return turns.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x")).select("block", F.transform("x", lambda x: x["said"]).alias("lines"))


@query(f"select text from {_BLOCKS.format(' ')}")
def sc14_subtitles(spark, d):
    at = _place(spark)
    cue = lambda line, i: F.concat_ws("\n", (i + 1).cast("string"), F.lit("00:00:01,000 --> 00:00:02,000"), F.concat(F.lit("<i>"), line, F.lit("</i>")), F.lit(""))
    _turns(spark, d).select("block", F.array_join(F.transform("lines", cue), "\n").alias("value")).write.partitionBy("block").text(at)
    return readers.transcripts(spark, at).select("text")


@query(f"select text from {_BLOCKS.format(' ')}")
def sc14_markup(spark, d):
    at = _place(spark)
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<p class='a'>\n"), x, F.lit("</p>\n"))), "")
    _turns(spark, d).select("block", F.concat(F.lit("<doc>"), body, F.lit("</doc>")).alias("value")).write.partitionBy("block").text(at)
    return readers.markup(spark, at).select("text")


@query("select conv_id // 10 as block, cast(count(*) as bigint) as intervals, sum(turn * 0.5::double) as starts from conversations group by 1")
def sc14_interval_tiers(spark, d):
    """Turns as intervals of a tier named after their block."""
    at = _place(spark)
    turns = table(spark, d, "conversations").select(F.expr("conv_id div 10").alias("block"), F.struct("conv_id", "turn").alias("x")).groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    number = lambda c: c.cast("decimal(20,1)").cast("string")
    each = lambda x, i: F.concat(F.lit("intervals ["), i + 1, F.lit("]:\nxmin = "), number(x["turn"] * 0.5), F.lit("\nxmax = "), number(x["turn"] * 0.5 + 0.5), F.lit('\ntext = "say ""x"""\n'))
    body = F.concat(F.lit('item []:\nitem [1]:\nname = "'), F.col("block"), F.lit('"\n'), F.array_join(F.transform("x", each), ""))
    turns.select("block", body.alias("value")).write.partitionBy("block").text(at)
    found = readers.interval_tiers(spark, at).where("text = 'say \"x\"' and end = start + 0.5")
    return found.groupBy(F.col("tier").cast("long").alias("block")).agg(F.count("*").alias("intervals"), F.sum("start").alias("starts"))


@query("select conv_id || '-' || turn as id, 'LINE OF TURN ' || turn as text from conversations")
def sc16_utterance_lists(spark, d):
    at = _place(spark)
    lines = F.concat_ws(" ", F.concat_ws("-", "conv_id", "turn"), F.lit("LINE OF TURN"), "turn")
    table(spark, d, "conversations").select(F.expr("conv_id div 100").alias("speaker"), lines.alias("value")).write.partitionBy("speaker").text(at)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(path(at), True)
    while files.hasNext():  # the form asks for names that Spark doesn't give
        one = files.next().getPath()
        if one.getName().startswith("part-"):
            fs.rename(one, path(one.getParent(), one.getName() + ".trans.txt"))
    return readers.utterance_lists(spark, at).select("id", "text")


@query(f"select source, doc_id, doc_id // 100 as recording, {norm('text')} as norm from documents")
def sc6_text_cache(spark, d):
    """Two runs of the cache build: the second finds every shard's marker and writes nothing."""
    at = _place(spark)
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    derived = {"recording": F.expr("doc_id div 100"), "norm": T.simple_norm(F.coalesce("text", F.lit("")))}
    writers.cache(docs, at, "source", **derived)
    again = writers.cache(docs, at, "source", **derived)
    if again:
        raise AssertionError(f"written twice: {again}")
    return spark.read.parquet(f"{at}/shards").select("source", "doc_id", "recording", "norm")


@query("select doc_id, lang, text from documents")
def sk2_sized_groups(spark, d):
    at = _place(spark)
    writers.sized(table(spark, d, "documents").select("doc_id", "lang", "text"), at, ["text", "doc_id"], 1 << 20)
    return spark.read.parquet(at)
