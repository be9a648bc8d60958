"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, linededup, orderhash, pii, quality, repair, simhash, spelling, tokencount, tokens
from .common import cut, shared_folder, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    done = chat.read_back(chat.format_chats(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    done = done.select("conv_id", "valid", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"))
    return done.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, a change of tokenizer, deletes of later exact copies, and batches that come twice, over all documents."""
    versions = {"words-1": None, "bytes-1": None, "word_bpe_49k": public_tokenizers.path("word_bpe_49k.json")}
    docs = table(spark, sf_dir, "documents").withColumn("same", F.sha2("text", 256))
    # written, so that texts are counted once and the rows' numbers hold
    rows = cut(tokencount.counted(docs, versions, ("doc_id", "same"))).withColumn("row", F.monotonically_increasing_id())
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = cut(rows.groupBy("same").agg(F.min(first).alias("first")).select(F.col("first.row").alias("row")))
    copies = rows.join(firsts, "row", "left_anti")
    rollup = tokencount.Rollup(spark, shared_folder(spark, "token-counts"))
    rollup.commit("1 insert", tokencount.inserts(rows, "words-1", "bytes-1"))
    rollup.commit("2 revise", tokencount.revisions(tokencount.inserts(rows, "words-1"), tokencount.inserts(rows, "word_bpe_49k")))
    rollup.commit("1 insert", tokencount.inserts(rows, "words-1", "bytes-1"))
    rollup.compact()
    for _ in range(2):
        rollup.commit("3 delete", tokencount.deletes(tokencount.inserts(copies, "bytes-1", "word_bpe_49k")))
    return rollup.totals()


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"), b"op3 demonstration key, not secret")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True, carry=["doc_id"])
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", "n_lines", "removed_lines")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokens.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    done = tokens.read_token_files(spark, manifest, folder)
    return done.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.clean_lines(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a hash of (conv_id, turn), and their cheapest repair."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = given.withColumn("h", F.crc32(name.cast("binary")) % 20).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    edits = repair.repair(rows)
    count = lambda c: F.count_if(c).cast("long")
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    told = edits.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.size(F.collect_set("turn")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("piece", "place", "edit", line.alias("line")))).alias("rows"),
    )
    whole = F.array_join(F.array_compact(F.transform("rows", lambda x: x["line"])), "\n")
    told = told.select("*", F.array_join(F.transform("rows", lambda x: x["edit"]), "").alias("audit"), F.sha2(whole, 256).alias("repaired_sha256"))
    each = given.select(F.col("conv_id").alias("own")).distinct().join(told, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return each.select(F.col("own").alias("conv_id"), *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in names])


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one run in 31 with a code point left out, grouped by spelling."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # runs of fewer code points than a word has can't become one
    runs = F.regexp_extract_all(low, F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), F.lit(0))
    each = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.select(F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run")).alias("word"))
    return spelling.group_variants(spelling.count_words(words))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ","), 256)
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), "contaminated",
        F.size("spans").cast("long").alias("n_spans"), F.length("text").cast("long").alias("clean_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_token_counts, op3_pii, op4_byte_bpe, op5_line_dedup,
        op6_packing, op7_simhash, op8_order_minhash, op9_token_files, op10_quality,
        op11_conversation_repair, op12_spelling, op13_decontaminate,
    )
}

ORACLES = {
    "op1_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<|' || role || '|>') + 1 + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))
                   + length('<|end|>') + 1)::BIGINT AS formatted_chars,
               regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user(,assistant,user)*(,assistant)?') AS valid
        FROM t GROUP BY conv_id""",
    # of the runs with 5 words or more, the shortest from each line on and up to each line are enough
    "op5_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no
          FROM documents WHERE text IS NOT NULL),
        counted AS (
          SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
        seq AS (
          SELECT *, row_number() OVER w AS i, sum(n) OVER w AS upto, sum(n) OVER w - n AS begin FROM counted WHERE n > 0
          WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        whole AS (
          SELECT doc_id, list(line ORDER BY i) AS ls FROM seq GROUP BY doc_id),
        spans AS (
          SELECT a.doc_id, a.i AS s, b.i AS e FROM seq a ASOF JOIN seq b ON a.doc_id = b.doc_id AND a.begin + 5 <= b.upto
          UNION
          SELECT a.doc_id, b.i, a.i FROM seq a ASOF JOIN seq b ON a.doc_id = b.doc_id AND a.upto - 5 >= b.begin),
        runs AS (
          SELECT doc_id, s, e, md5(array_to_string(ls[s:e], chr(10))) AS run FROM spans JOIN whole USING (doc_id)),
        firsts AS (
          SELECT *, min(struct_pack(d := doc_id, i := s)) OVER (PARTITION BY run) AS first FROM runs),
        gone AS (
          SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM firsts WHERE struct_pack(d := doc_id, i := s) > first),
        kept AS (
          SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.line_no) AS text, count(*) AS n_kept
          FROM counted c LEFT JOIN seq s ON s.doc_id = c.doc_id AND s.line_no = c.line_no
          LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i WHERE g.i IS NULL GROUP BY c.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
               len(string_split(d.text, chr(10))) AS n_lines,
               len(string_split(d.text, chr(10))) - coalesce(k.n_kept, 0) AS removed_lines
        FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    # a text less its spans loses them and what follows each up to the next word
    "op13_decontaminate": r"""
        WITH d AS (
          SELECT doc_id, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (
          SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
        grams AS (
          SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS gram
          FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        places AS (
          SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM grams)),
        hits AS (
          SELECT p.doc_id, p.i, p.k, g.item FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram FROM places) p
          JOIN grams g ON g.k = p.k AND g.gram = p.gram),
        hit_words AS (
          SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM (SELECT DISTINCT doc_id, i, k FROM hits)),
        spans AS (
          SELECT doc_id, min(i) AS s, max(i) AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit_words)
          GROUP BY doc_id, g),
        pieces AS (
          SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS j, CASE WHEN regexp_matches(p[1], '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') THEN 0 ELSE 1 END AS f
          FROM (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS p
                FROM documents WHERE doc_id IN (SELECT doc_id FROM spans))),
        lost AS (
          SELECT doc_id, sum(length(p[j])) AS n FROM pieces x
          WHERE EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = x.doc_id AND j BETWEEN 2 * s.s - 1 + f AND 2 * s.e + f) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
               sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated,
               coalesce(s.n, 0) AS n_spans, length(d.text) - coalesce(l.n, 0)::BIGINT AS clean_chars
        FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit_words GROUP BY doc_id) h ON h.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id) i ON i.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id
        LEFT JOIN lost l ON l.doc_id = d.doc_id""",
}
