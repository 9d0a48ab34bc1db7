"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The prompt is the longest common turn prefix, rendered once. A completion is the rest of its
conversation; its spans (code points, ends exclusive) are what a model is trained on: the
assistant's texts with their end marks. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"
#: A turn is OPEN role CLOSE newline text END newline; OPEN in roles and texts is escaped, so that no text can forge a turn.
OPEN, CLOSE, END, ESCAPED = "<|", "|>", "<|end|>", "<\\|"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns by number (then role and text), null roles as "unknown", null texts as "".

    Repeated rows stay turns of their own. A null conv_id is one conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def weaker(turns: Column) -> Column:
    """A conversation with a worse last answer: that of the assistant's turn before, or (of a single one) its first half by words."""
    places = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)), lambda i: i.isNotNull())
    last, before = F.get(places, F.size(places) - 1), F.get(places, F.size(places) - 2)
    words = F.split(F.get(turns, last)["text"], " ")
    half = F.array_join(F.slice(words, F.lit(1), F.ceil(F.size(words) / 2).cast("int")), " ")
    text = F.when(F.size(places) > 1, F.get(turns, before)["text"]).otherwise(half)
    return F.transform(turns, lambda t, i: F.when(i == last, F.struct(t["role"].alias("role"), text.alias("text"))).otherwise(F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns both begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(F.array_position(same, False) - 1).cast("int")


def _escaped(x: Column) -> Column:
    return F.replace(x, F.lit(OPEN), F.lit(ESCAPED))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _escaped(t["role"]), F.lit(CLOSE + "\n"))


def _body(t: Column) -> Column:
    return F.concat(_escaped(t["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def trained_spans(turns: Column) -> Column:
    """array<struct<start,end>> of what render(turns) trains on."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, t: Column) -> Column:
        low = acc["at"] + F.length(_head(t))
        high = low + F.length(_body(t))
        span = F.when(t["role"] == TRAINED_ROLE, F.array(F.struct(low.alias("start"), high.alias("end")))).otherwise(none)
        return F.struct((high + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs of turn arrays (array<struct<role, text>>), formatted.

    Adds n_prefix, prompt, chosen_text, chosen_spans, rejected_text, rejected_spans;
    the two turn columns and columns with these names go. A null conversation counts as one
    without turns; equal conversations give empty completions; pairs repeat as they came.
    """
    new = {"n_prefix", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans"}
    kept = [c for c in pairs.columns if c.lower() not in new | {chosen.lower(), rejected.lower()}]
    none = F.expr(f"cast(array() as {TURN})")
    a, b = (F.coalesce(F.col(c).cast(TURN), none) for c in (chosen, rejected))
    rows = pairs.select(*[F.col(f"`{c}`") for c in kept], a.alias("__a"), b.alias("__b"))
    rows = rows.withColumn("n_prefix", common_prefix(F.col("__a"), F.col("__b")))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c), F.lit(1)))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_prefix",
        render(F.slice("__a", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        *[f(rest(c)).alias(f"{name}_{what}") for name, c in (("chosen", "__a"), ("rejected", "__b")) for what, f in (("text", render), ("spans", trained_spans))],
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def digest(turns: DataFrame) -> DataFrame:
    """Each conversation preferred to its weaker version: conv_id, n_turns, n_prefix, prompt, both completions and their spans as text."""
    pairs = conversations(turns).select("conv_id", F.size("turns").alias("n_turns"), F.col("turns").alias("chosen"), weaker(F.col("turns")).alias("rejected"))
    done = format_preferences(pairs)
    return done.select("conv_id", "n_turns", "n_prefix", "prompt", "chosen_text", listed(F.col("chosen_spans")).alias("chosen_spans"), "rejected_text", listed(F.col("rejected_spans")).alias("rejected_spans"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations),
m AS (SELECT conv_id, max(i) AS n, max(i) FILTER (role = 'assistant') AS la FROM t GROUP BY conv_id),
p AS (SELECT t.conv_id, max(i) AS lb FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id WHERE role = 'assistant' AND i < la GROUP BY t.conv_id),
w AS (
  SELECT m.conv_id, m.n, m.la, a.text AS good,
         CASE WHEN p.lb IS NOT NULL THEN b.text
              ELSE array_to_string(string_split(a.text, ' ')[1:(len(string_split(a.text, ' ')) + 1) // 2], ' ') END AS bad
  FROM m LEFT JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
  LEFT JOIN t a ON a.conv_id IS NOT DISTINCT FROM m.conv_id AND a.i = m.la
  LEFT JOIN t b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.i = p.lb),
x AS (
  SELECT t.conv_id, t.i, w.n, CASE WHEN la IS NULL OR good = bad THEN w.n ELSE la - 1 END AS k, role,
         '<|' || replace(role, '<|', '<\|') || '|>' || chr(10) AS head,
         replace(text, '<|', '<\|') || '<|end|>' AS body,
         replace(CASE WHEN t.i = la THEN bad ELSE text END, '<|', '<\|') || '<|end|>' AS worse
  FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
y AS (
  SELECT *, CASE WHEN i > k THEN sum(CASE WHEN i > k THEN length(head) + length(body) + 1 ELSE 0 END) OVER c - length(body) - 1 END AS a,
            CASE WHEN i > k THEN sum(CASE WHEN i > k THEN length(head) + length(worse) + 1 ELSE 0 END) OVER c - length(worse) - 1 END AS b
  FROM x WINDOW c AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, CAST(k AS INTEGER) AS n_prefix,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (i <= k), '') AS prompt,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (i > k), '') AS chosen_text,
       coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(body) AS BIGINT), ',' ORDER BY i) FILTER (i > k AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(head || worse || chr(10), '' ORDER BY i) FILTER (i > k), '') AS rejected_text,
       coalesce(string_agg(CAST(b AS BIGINT) || ':' || CAST(b + length(worse) AS BIGINT), ',' ORDER BY i) FILTER (i > k AND role = 'assistant'), '') AS rejected_spans
FROM y GROUP BY conv_id, n, k
"""
