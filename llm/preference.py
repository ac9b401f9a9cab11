"""Preference formatting: pairs of conversations as one prompt and two masked completions.

All of it is DataFrame expressions. The turns of a pair's chosen and rejected
conversation are gathered in order; the longest common prefix of turns is the prompt,
rendered once; what follows is rendered as two completions, each with a mask of spans
that says which characters are trained on (assistant turns and their end mark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """(start, length, train) of each header and each body of the turns, in characters."""
    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        body = F.length(t["text"]) + len(CLOSE)
        spans = F.array(F.struct(acc["at"].alias("start"), head.alias("length"), F.lit(False).alias("train")),
                        F.struct((acc["at"] + head).alias("start"), body.alias("length"), (t["role"] == "assistant").alias("train")))
        return F.struct((acc["at"] + head + body).alias("at"), F.concat(acc["spans"], spans).alias("spans"))

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,length:int,train:boolean>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def _gathered(turns: DataFrame, name: str) -> DataFrame:
    t = turns.where("pair_id is not null").select(
        "pair_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return t.groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias(name))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair_id of both tables (pair_id, turn, role, text).

    pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. Turns
    are ordered by turn (null first), then role and text; repeated rows are repeated turns.
    Turns are common if role and text are equal (null counts as ""). If one conversation
    is the other's prefix, its completion is ""; so are both if they are equal. Rows
    without a pair_id, pairs with one side only, and other columns are left out.
    """
    both = _gathered(chosen, "a").join(_gathered(rejected, "b"), "pair_id")
    differ = F.transform(F.arrays_zip("a", "b"), lambda x: ~(x["a"]["role"].eqNullSafe(x["b"]["role"]) & x["a"]["text"].eqNullSafe(x["b"]["text"])))
    first = F.array_position(differ, F.lit(True))
    n = F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int")
    both = both.withColumn("n", n)
    rest = {c: F.slice(c, F.col("n") + 1, F.size(c)) for c in "ab"}
    return both.select("pair_id", F.col("n").alias("n_prompt_turns"), _render(F.slice("a", 1, F.col("n"))).alias("prompt"),
                       _render(rest["a"]).alias("chosen"), _render(rest["b"]).alias("rejected"),
                       _mask(rest["a"]).alias("chosen_mask"), _mask(rest["b"]).alias("rejected_mask"))


def mask_text(mask: str) -> Column:
    """A mask as text: start+length and t or f (trained or not) of each span, between blanks."""
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"), F.when(s["train"], "t").otherwise("f"))), " ")


def pairs_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations.

    Each conversation is the chosen one of a pair. Its rejected one is the same up to its
    last assistant turn, which is replaced by the last assistant turn of the partner
    conversation (ids 2k and 2k + 1 are partners), and ends there; without a partner's
    turn it just ends.
    """
    c = conversations.where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = c.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(
        F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("answer"))
    before = c.join(last.select("pair_id", "last"), "pair_id", "left").where("last is null or turn is null or turn < last")
    swap = last.select((F.col("pair_id").bitwiseXOR(F.lit(1))).alias("pair_id"), "answer").join(last.select("pair_id", "last"), "pair_id")
    swapped = swap.select("pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return c, before.select(*c.columns).unionByName(swapped)


SQL = """
WITH c AS (SELECT conv_id AS p, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT p, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY p),
w AS (SELECT l.p, l.last, max(c.text) AS answer FROM l JOIN c ON c.p = l.p AND c.turn = l.last AND c.role = 'assistant' GROUP BY ALL),
r AS (SELECT c.* FROM c LEFT JOIN l ON c.p = l.p WHERE l.last IS NULL OR c.turn < l.last
      UNION ALL SELECT l.p, l.last, 'assistant', w.answer FROM l JOIN w ON xor(l.p, 1) = w.p),
a AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY turn, role, text) AS i FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY turn, role, text) AS i FROM r),
n AS (SELECT ids.p, coalesce(min(x.i) - 1, (SELECT count(*) FROM a WHERE a.p = ids.p)) AS n FROM (SELECT p FROM a INTERSECT SELECT p FROM b) ids
      LEFT JOIN (SELECT coalesce(a.p, b.p) AS p, coalesce(a.i, b.i) AS i FROM a FULL JOIN b ON a.p = b.p AND a.i = b.i
                 WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) x ON x.p = ids.p GROUP BY ids.p),
s AS (SELECT n.p, n.n, t.side, t.i, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS m, t.i > n.n AS rest, t.role = 'assistant' AS train,
             length(t.role) + 5 AS head, length(t.text) + 8 AS body
      FROM n JOIN (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b) t ON t.p = n.p),
k AS (SELECT *, CAST(coalesce(sum(head + body) OVER (PARTITION BY p, side, rest ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun FROM s),
u AS (SELECT *, concat(begun, '+', head, 'f ', begun + head, '+', body, CASE WHEN train THEN 't' ELSE 'f' END) AS spans FROM k)
SELECT p AS pair_id, CAST(n AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(m, '' ORDER BY i) FILTER (side = 'a' AND NOT rest), '') AS prompt,
       coalesce(string_agg(m, '' ORDER BY i) FILTER (side = 'a' AND rest), '') AS chosen,
       coalesce(string_agg(m, '' ORDER BY i) FILTER (side = 'b' AND rest), '') AS rejected,
       coalesce(string_agg(spans, ' ' ORDER BY i) FILTER (side = 'a' AND rest), '') AS chosen_mask,
       coalesce(string_agg(spans, ' ' ORDER BY i) FILTER (side = 'b' AND rest), '') AS rejected_mask,
       CAST(coalesce(sum(body) FILTER (side = 'a' AND rest AND train), 0) AS BIGINT) AS chosen_trained,
       CAST(coalesce(sum(body) FILTER (side = 'b' AND rest AND train), 0) AS BIGINT) AS rejected_trained
FROM u GROUP BY p, n"""
