"""Chat formatting by quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of ``>`` signs that it starts with. The lines of one level that follow each other
are a quotation; it is joined, folded (lower case, single blanks) and cut into sentences, the passages, so that other
line breaks than the original's do no harm. Level 0, without the line that announces a quotation, is what the message
itself says. Passages are hashed (128 bits) and joined to the messages of the same conversation that say them first.

A message replies to the message that says most of its passages at the lowest level that has a link (ties: the later
one). Messages that are linked form threads; root_turn is the turn of a thread's first message and depth the number of
replies from there. Ordered by (conv_id, root_turn, turn) threads stand together and replies follow what they answer.

DataFrame functions only. Originals are reduced to one row for each (conversation, passage) before they are joined, so
a conversation or passage that a third of all rows have costs no pairs, and no conversation is ever collected.

Defined results: a null text stays null, links to nothing and is linked by nothing; a quotation that nothing earlier
says is removed but not linked; a null conv_id is a conversation of its own; a null turn comes before all others. Rows
that agree in conv_id, turn and text are one message and get the same result; a text of any length is parsed whole; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm._common import materialize

_MARK = r"^(?:[ \t]*>)+"
#: How a line before a quotation ends that says who wrote it.
_SAID = r"(?i)(?:wrote|writes|schrieb.*|a écrit|escribió|escreveu|ha scritto)\s*:\s*$"


def _lines(text: str) -> Column:
    """(level, said) of each line."""
    mark = lambda x: F.regexp_extract(x, _MARK, 0)
    return F.transform(
        F.split(F.col(text), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.substring(x, F.length(mark(x)) + 1, F.length(x)).alias("said")),
    )


def _passages(lines: str, level: Column) -> Column:
    """The distinct sentences of a level, folded; lines of other levels stand between quotations."""
    flat = F.array_join(F.transform(F.col(lines), lambda x: F.when(x["level"] == level, x["said"]).otherwise(F.lit("\u0001"))), " ")
    folded = F.regexp_replace(F.lower(flat), r"\s+", " ")
    return F.array_distinct(F.filter(F.transform(F.split(folded, "(?<=[.!?]) |\u0001", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def _own(lines: str) -> Column:
    """The lines of level 0 without those that announce a quotation."""
    l = F.col(lines)  # noqa: E741
    announces = lambda x, i: (x["level"] == 0) & x["said"].rlike(_SAID) & (F.coalesce(F.try_element_at(l, i + 2)["level"], F.lit(0)) > 0)
    return F.filter(l, lambda x, i: (x["level"] == 0) & ~announces(x, i))


def parse(messages: DataFrame) -> DataFrame:
    """Messages (conv, turn, th, text) with lines, own and quoted."""
    rows = messages.withColumn("lines", _lines("text"))
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    return rows.withColumn("quoted", F.coalesce(quoted, F.lit(False))).withColumn("own", F.when(F.col("quoted"), _own("lines")).otherwise(F.col("lines")))


def links(parsed: DataFrame) -> DataFrame:
    """(conv, turn, th, level, p_turn, p_th, n): how many passages of a level each earlier message said first."""
    digest = lambda x: [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), F.reverse(x)).alias("h2")]
    asks = parsed.filter("quoted").withColumn("level", F.explode(F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda x: x > 0))))
    asks = asks.select("conv", "turn", "th", "level", F.explode(_passages("lines", F.col("level"))).alias("p"))
    asks = asks.select("conv", "turn", "th", "level", *digest(F.col("p"))).distinct()  # a row that stands twice asks once
    says = parsed.select("conv", "turn", "th", F.explode(_passages("own", F.lit(0))).alias("p")).select("conv", "turn", "th", *digest(F.col("p")))
    first = says.groupBy("conv", "h1", "h2").agg(F.min(F.struct("turn", "th")).alias("first"))
    met = asks.join(first, ["conv", "h1", "h2"]).filter(F.struct("turn", "th") > F.col("first"))
    return met.groupBy("conv", "turn", "th", "level", F.col("first.turn").alias("p_turn"), F.col("first.th").alias("p_th")).agg(F.count("*").alias("n"))


def parents(linked: DataFrame) -> DataFrame:
    """(conv, turn, th, p_turn, p_th, n_linked) of the messages that reply to one."""
    best = F.max_by(F.struct("p_turn", "p_th"), F.struct(-F.col("level"), F.col("n"), F.col("p_turn"), F.col("p_th")))
    out = linked.groupBy("conv", "turn", "th").agg(best.alias("p"), F.sum("n").alias("n_linked"))
    return out.select("conv", "turn", "th", "p.p_turn", "p.p_th", "n_linked")


def roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, th, r_turn, r_th, depth): each reply's thread, by doubling the way up until all are at the top."""
    now = materialize(replies.select("conv", "turn", "th", F.col("p_turn").alias("r_turn"), F.col("p_th").alias("r_th"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.select("conv", F.col("turn").alias("r_turn"), F.col("th").alias("r_th"), F.col("r_turn").alias("u_turn"), F.col("r_th").alias("u_th"), F.col("depth").alias("more"))
        step = now.join(up, ["conv", "r_turn", "r_th"], "left").select(
            "conv", "turn", "th",
            F.when(F.col("more").isNull(), F.col("r_turn")).otherwise(F.col("u_turn")).alias("r_turn"),
            F.when(F.col("more").isNull(), F.col("r_th")).otherwise(F.col("u_th")).alias("r_th"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved"),
        )
        step = materialize(step, "threads")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, text, ...) with text cleaned, and parent_turn, root_turn, depth, n_quotes and n_linked."""
    new = ("parent_turn", "root_turn", "depth", "n_quotes", "n_linked")
    keep = [c for c in messages.columns if c.lower() not in new]
    names = [f"c{i}" for i in range(len(keep))]
    at = {c.lower(): n for c, n in zip(keep, names, strict=True)}
    # Nulls get a value of their own so that plain joins find them.
    rows = messages.select(*keep).toDF(*names).withColumns({
        "conv": F.coalesce(F.col(at["conv_id"]).cast("string"), F.lit("\u0000")),
        "turn": F.coalesce(F.col(at["turn"]).cast("long"), F.lit(-(2**63))),
        "th": F.xxhash64(at["text"]),
    })
    slim = rows.select("conv", "turn", "th", F.col(at["text"]).alias("text"))
    replies = materialize(parents(links(parse(slim))), "replies")
    tree = replies.join(roots(replies), ["conv", "turn", "th"])
    shown = parse(rows.withColumn("text", F.col(at["text"]))).join(tree, ["conv", "turn", "th"], "left")
    clean = F.when(F.col("quoted"), F.trim(F.array_join(F.transform("own", lambda x: x["said"]), "\n"), F.lit(" \t\r\n"))).otherwise(F.col("text"))
    levels = F.transform("lines", lambda x: x["level"])
    starts = F.filter(levels, lambda x, i: (x > 0) & ((i == 0) | (F.coalesce(F.try_element_at(levels, i), F.lit(0)) != x)))
    no_turn = lambda c: F.expr(f"nullif({c}, {-(2**63) + 1}L - 1L)")
    # Names that no input column has, until the end: a helper column may be called as one of theirs.
    out = [(clean if n == at["text"] else F.col(n)).alias(f"x_{n}") for n in names]
    depth, linked = F.coalesce("depth", F.lit(0)), F.coalesce("n_linked", F.lit(0))
    n_quotes = F.when(F.col("quoted"), F.size(starts)).otherwise(0).cast("long")
    made = (no_turn("p_turn"), no_turn("coalesce(r_turn, turn)"), depth, n_quotes, linked)
    return shown.select(*out, *[c.alias(f"y_{n}") for c, n in zip(made, new, strict=True)]).toDF(*keep, *new)


#: The same for tables whose (conv_id, turn) are unique and not null, by comparing passages instead of hashes.
ORACLE_SQL = r"""
WITH RECURSIVE line AS (
  SELECT conv_id, turn, i, l, regexp_extract(l, '^(?:[ \t]*>)+') AS mark
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE text IS NOT NULL)
), said AS (
  SELECT conv_id, turn, i, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, substr(l, length(mark) + 1) AS said FROM line
), near AS (
  SELECT *, coalesce(lead(level) OVER w, 0) AS after, lag(level) OVER w AS before, max(level) OVER (PARTITION BY conv_id, turn) AS deepest
  FROM said WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), own AS (
  SELECT conv_id, turn, i, said FROM near
  WHERE level = 0 AND NOT (deepest > 0 AND after > 0 AND regexp_matches(said, '(?i)(?:wrote|writes|schrieb.*|a écrit|escribió|escreveu|ha scritto)\s*:\s*$'))
), levels AS (
  SELECT DISTINCT conv_id, turn, level FROM near WHERE level > 0
), flat AS (
  SELECT v.conv_id, v.turn, v.level, string_agg(CASE WHEN n.level = v.level THEN n.said ELSE chr(1) END, ' ' ORDER BY n.i) AS t
  FROM levels v JOIN near n ON n.conv_id = v.conv_id AND n.turn = v.turn GROUP BY ALL
  UNION ALL SELECT conv_id, turn, 0, string_agg(said, ' ' ORDER BY i) FROM own GROUP BY ALL
), passage AS (
  SELECT DISTINCT conv_id, turn, level, p FROM (
    SELECT conv_id, turn, level, trim(unnest(string_split(regexp_replace(regexp_replace(lower(t), '[\s\v]+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))) AS p FROM flat
  ) WHERE p <> ''
), origin AS (
  SELECT conv_id, p, min(turn) AS turn FROM passage WHERE level = 0 GROUP BY ALL
), link AS (
  SELECT a.conv_id, a.turn, a.level, o.turn AS p_turn, count(*) AS n FROM passage a JOIN origin o ON o.conv_id = a.conv_id AND o.p = a.p AND o.turn < a.turn WHERE a.level > 0 GROUP BY ALL
), reply AS (
  SELECT conv_id, turn, arg_max(p_turn, (-level, n, p_turn)) AS p_turn, CAST(sum(n) AS BIGINT) AS n_linked FROM link GROUP BY ALL
), up AS (
  SELECT conv_id, turn, p_turn AS above, 1 AS depth FROM reply
  UNION ALL SELECT u.conv_id, u.turn, r.p_turn, u.depth + 1 FROM up u JOIN reply r ON r.conv_id = u.conv_id AND r.turn = u.above
), top AS (
  SELECT conv_id, turn, arg_max(above, depth) AS root_turn, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY ALL
), shape AS (
  SELECT conv_id, turn, max(level) AS deepest, count(*) FILTER (level > 0 AND before IS DISTINCT FROM level) AS n_quotes FROM near GROUP BY ALL
), clean AS (
  SELECT conv_id, turn, string_agg(said, chr(10) ORDER BY i) AS t FROM own GROUP BY ALL
)
SELECT c.conv_id, c.turn, c.role, CASE WHEN s.deepest > 0 THEN trim(coalesce(k.t, ''), ' ' || chr(9) || chr(10) || chr(13)) ELSE c.text END AS text,
       r.p_turn AS parent_turn, coalesce(t.root_turn, c.turn) AS root_turn, coalesce(t.depth, 0) AS depth, coalesce(s.n_quotes, 0) AS n_quotes, coalesce(r.n_linked, 0) AS n_linked
FROM conversations c LEFT JOIN shape s ON s.conv_id = c.conv_id AND s.turn = c.turn LEFT JOIN clean k ON k.conv_id = c.conv_id AND k.turn = c.turn
LEFT JOIN reply r ON r.conv_id = c.conv_id AND r.turn = c.turn LEFT JOIN top t ON t.conv_id = c.conv_id AND t.turn = c.turn
"""
