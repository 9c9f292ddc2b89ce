"""Benchmark decontamination by template windows (DataFrame and SQL functions only).

A text becomes words in lower case, in which numbers, units after numbers and names (runs of capitalised words inside a sentence)
are replaced by typed placeholders. Windows of ``width`` canonical words of the benchmark items are hash-joined with all
windows of all documents, so a question whose numbers or names were changed still matches. For every alignment of a
document and an item, slot consistency is checked: one value of the item must always stand for one value of the document. An item leaks into a
document if the consistent alignments cover at least ``coverage`` of the item's windows.

A text has three forms, joined apart: in ``typed``, capitalised words inside a sentence are names; in ``starts``, those that begin a sentence or
the text as well, whatever the word (an ordinary word must then stand for one word); in ``blind``, the text is in lower case and no word is
a name, so a change of case alters nothing. Windows with fewer than ``literals`` literal words would match by their slots alone; ``blind`` joins them
on the words and numbers themselves, so every item has a window to search, and the other forms leave them out. The form in which most of the item is found decides; ``typed`` goes first if the item leaks in it.

Documents' windows are (row key, place, hash) rows. A bitmap of the item windows' hashes, of one size for any benchmark, goes to every task and leaves
of them few but the matches, which are then joined with the item windows; so the plan is the same at all sizes. The words of a document are only read again for matches
that have slots, and again a bitmap of their keys keeps all other texts where they are. A row's key is made of its id and its text, so rows that
share an id, and null ids, are kept apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import hash_filter, materialise, passing, row_key, text_or_empty, without_keys

WIDTH = 8
LITERALS = 4
COVERAGE = 0.5

UNITS = ("km cm mm nm mi miles mile m meters metres feet foot ft inches inch yards kg mg g grams pounds lbs lb oz tons t l ml liters "
         "litres gallons s sec seconds min minutes h hours hour days day weeks week months month years year dollars cents euros "
         "percent degrees mph kmh kph w kw v hz gb mb kb").split()
_LETTER, _CAP = r"[\p{L}\p{M}]", r"\p{Lu}[\p{L}\p{M}]*"
NAME = rf"([\p{{L}}\p{{N}},;] )({_CAP}(?: {_CAP}){{0,3}})"
UNIT = rf"(\p{{N}} ?)({'|'.join(sorted(UNITS, key=len, reverse=True))})([^\p{{L}}\p{{M}}]|$)"
ANY_NAME = rf"(^|[^\p{{L}}\p{{M}}])({_CAP}(?: {_CAP}){{0,3}})"
FORMS = ("typed", "starts", "blind")
TOKEN = rf"\x02{_CAP}(?: {_CAP}){{0,3}}|\x03?{_LETTER}+|\p{{N}}+(?:[.,:/]\p{{N}}+)*"


def raw_words(text_column: str = "text", form: str = "typed") -> Column:
    """Words, numbers and names of a text in one of ``FORMS``; units begin with \\x03 and names with \\x02."""
    text = F.regexp_replace(text_or_empty(text_column), "[\x02\x03]", " ")
    marked = F.regexp_replace(F.lower(text) if form == "blind" else text, UNIT, "$1\x03$2$3")
    if form != "blind":
        marked = F.regexp_replace(marked, NAME if form == "typed" else ANY_NAME, "$1\x02$2")
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def canonical(words: str) -> Column:
    """The words with placeholders for typed slots."""
    return F.expr(f"transform({words}, w -> {_CANON})")


_CANON = ("CASE WHEN w >= ':' THEN lower(w) WHEN w < '\x03' THEN '<name>' WHEN w < '\x04' THEN '<unit>' WHEN w >= '0' AND w < ':' THEN '<num>' ELSE lower(w) END")


def item_windows(benchmark: DataFrame, item_column: str, text_column: str, width: int, literals: int) -> DataFrame:
    """(item_id, form, exact, q, width, h, slots, values, windows): windows with enough literal words, and in the form ``blind`` the others
    by their raw words (exact, without slots); short items are one window."""
    texts = benchmark.select(F.col(item_column).alias("item_id"), F.col(text_column).alias("text"))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), raw_words("text", f).alias("raw")) for f in FORMS])
    items = (texts.select("item_id", F.explode_outer(forms).alias("f")).select("item_id", "f.form", "f.raw").where("size(raw) > 0").distinct()
             .withColumn("words", canonical("raw")).withColumn("width", F.least(F.lit(width), F.size("words"))))
    cut = items.select("item_id", "form", "raw", "words", "width", F.explode_outer(F.expr("sequence(0, size(words) - width)")).alias("q"))
    cut = (cut.withColumn("own", F.expr("slice(words, q + 1, width)"))
           .withColumn("slots", F.expr("filter(sequence(0, width - 1), k -> own[k] IN ('<name>', '<unit>', '<num>'))"))
           .withColumn("exact", F.col("width") - F.size("slots") < F.lit(literals)).where((F.col("form") == "blind") | ~F.col("exact"))
           .withColumn("own", F.expr("IF(exact, slice(raw, q + 1, width), own)"))
           .withColumn("slots", F.expr("IF(exact, filter(slots, k -> false), slots)"))
           .withColumn("values", F.expr("transform(slots, k -> raw[q + k])")))
    found = cut.select("item_id", "form", "exact", "q", "width", F.expr("xxhash64(transform(own, w -> xxhash64(w)))").alias("h"), "slots", "values")
    total = found.groupBy("item_id", "form").agg(F.count_distinct("q").alias("windows"))
    return (found.join(total.withColumnsRenamed({"item_id": "item", "form": "of"}), F.expr("item_id <=> item AND form = of"))
            .drop("item", "of"))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str, width: int, literals: int,
           coverage: float) -> DataFrame:
    """``leaks`` with the row key."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), row_key(id_column, text_column).alias("key"))
    items = materialise(item_windows(benchmark, item_column, item_text, width, literals), "items")
    kinds = ["form", "exact", "width"]  # 4 * width of them at most
    known = [tuple(r) for r in items.select(*kinds).distinct().collect()]
    windows = hash_filter(items, F.col("h"))

    def one(form: str, exact: bool, w: int) -> DataFrame:
        word = "w" if exact else _CANON
        words = narrow.select("key", "doc_id", raw_words("text", form).alias("raw")).select("key", "doc_id", F.expr(f"transform(raw, w -> xxhash64({word}))").alias("words"))
        # an inner explode would infer a filter on the words, which is pushed below them and so computes them twice and more
        place = F.posexplode_outer(F.expr(f"CASE WHEN size(words) >= {w} THEN sequence(0, size(words) - {w}) ELSE array() END"))
        h = f"CASE WHEN pos IS NOT NULL THEN xxhash64({', '.join(f'words[pos + {k}]' for k in range(w))}) END AS h"
        spread = words.select("key", "doc_id", "words", place.alias("at", "pos")).selectExpr("key", "doc_id", "pos", h)
        return passing(spread, F.col("h"), windows).selectExpr("*", f"'{form}' AS form", f"{str(exact).lower()} AS exact", f"{w} AS width")

    spread = reduce(DataFrame.unionByName, [one(*k) for k in sorted(known) or [(FORMS[0], False, width)]])
    hits = materialise(spread.join(items, [*kinds, "h"])
                       .select("key", "doc_id", "item_id", "form", "pos", "q", "slots", "values", "windows"), "hits")

    aligned = hits.withColumn("shift", F.col("pos") - F.col("q"))
    # a form is checked where it can leak, unless ``typed`` leaks without slots to check; ``typed`` always is
    bound = aligned.groupBy("key", "item_id", "form").agg((F.count_distinct("q") / F.max("windows")).alias("bound"), F.max(F.size("slots")).alias("most"))
    sure = f"exists(f, y -> y.form = '{FORMS[0]}' AND y.bound >= {coverage} AND y.most = 0)"
    checked = f"filter(f, x -> x.form = '{FORMS[0]}' OR (x.bound >= {coverage} AND NOT {sure}))"
    open_pairs = materialise(bound.groupBy("key", "item_id").agg(F.collect_list(F.struct("form", "bound", "most")).alias("f"))
                             .select("key", "item_id", F.explode_outer(F.expr(checked)).alias("x")).select("key", "item_id", "x.form"), "open")
    same = F.expr("key = pk AND item_id <=> pi AND form = pf")
    aligned = aligned.join(open_pairs.select(F.col("key").alias("pk"), F.col("item_id").alias("pi"), F.col("form").alias("pf")), same, "left_semi")
    slotted = aligned.where("size(slots) > 0")
    needed = slotted.select("key").distinct()
    forms = F.array(*[F.struct(F.lit(f).alias("form"), raw_words("text", f).alias("raw")) for f in FORMS])
    few = passing(narrow.select("key", "text"), F.col("key"), hash_filter(needed, F.col("key")))
    again = (few.join(needed, "key").dropDuplicates(["key"]).select("key", F.explode_outer(forms).alias("f"))
             .select("key", "f.form", "f.raw"))
    pairs = (slotted.join(again, ["key", "form"])
             .select("key", "item_id", "form", "shift", F.expr("transform(slots, (k, i) -> struct(values[i] AS old, raw[pos + k] AS new))").alias("pair"))
             .select("key", "item_id", "form", "shift", F.explode_outer("pair").alias("pair")))
    bad = (pairs.groupBy("key", "item_id", "form", "shift", "pair.old").agg((F.min("pair.new") != F.max("pair.new")).alias("odd"))
           .where("odd").select(F.col("key").alias("k"), F.col("item_id").alias("i"), F.col("form").alias("f"), F.col("shift").alias("s"), "odd").distinct())
    told = aligned.join(bad, F.expr("key = k AND item_id <=> i AND form = f AND shift = s"), "left")
    found = told.groupBy("key", "doc_id", "item_id", "form").agg(
        F.count_distinct(F.when(F.col("odd").isNull(), F.col("q"))).alias("matched"), F.max("windows").alias("windows"),
        F.max("odd").isNull().alias("consistent"))
    share = F.col("matched") / F.col("windows")
    order = F.struct((F.col("leaked") & (F.col("form") == FORMS[0])).alias("first"), "coverage", "form", "matched", "windows", "consistent", "leaked")
    best = found.withColumns({"coverage": share, "leaked": share >= coverage}).groupBy("key", "doc_id", "item_id").agg(F.max(order).alias("best"))
    return best.select("key", "doc_id", "item_id", *[f"best.{c}" for c in ("matched", "windows", "consistent", "coverage", "leaked")])


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          item_column: str = "item_id", item_text: str = "text", width: int = WIDTH, literals: int = LITERALS,
          coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that share a window in the form ``typed`` or leak in another: doc_id, item_id, matched, windows, consistent,
    coverage, leaked.

    matched: the item's windows found in consistent alignments; consistent: false if any alignment isn't. Null texts are empty and match nothing;
    items repeated with one id count once per text; rows of ``docs`` repeated with one id and text count once, those of one id and
    different texts each. Null ids are ids like any other. Empty tables give no rows; other columns aren't read.
    """
    return _leaks(docs, benchmark, id_column, text_column, item_column, item_text, width, literals, coverage).drop("key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns unchanged. Of rows that share an id (or have none) only those go whose own text leaks."""
    found = _leaks(docs, benchmark, id_column, text_column, "item_id", "text", WIDTH, LITERALS, COVERAGE)
    return without_keys(docs, row_key(id_column, text_column), materialise(found.where("leaked").select("key").distinct(), "leaked"))


_SQL_WORDS = (
    "regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x02\\x03]', ' ', 'g'), "
    f"'{UNIT}', '\\1' || chr(3) || '\\2\\3', 'g'), '{NAME}', '\\1' || chr(2) || '\\2', 'g'), '{TOKEN}')")
_SQL_CANON = ("list_transform(raw, lambda w: CASE WHEN w < chr(3) THEN '<name>' WHEN w < chr(4) THEN '<unit>' "
              "WHEN w >= '0' AND w < ':' THEN '<num>' ELSE lower(w) END)")
SQL = f"""
WITH iw AS MATERIALIZED (SELECT DISTINCT item_id, {_SQL_WORDS} AS raw FROM benchmark),
ic AS (SELECT item_id, raw, {_SQL_CANON} AS words, least({WIDTH}, len(raw)) AS width FROM iw WHERE len(raw) > 0),
ix AS (SELECT item_id, raw, words, width, unnest(range(0, len(words) - width + 1)) AS q FROM ic),
iy AS (SELECT item_id, raw, q, width, words[q + 1 : q + width] AS own FROM ix),
iz AS (SELECT item_id, raw, q, width, own, list_filter(range(0, width), lambda k: own[k + 1] IN ('<name>', '<unit>', '<num>')) AS slots FROM iy),
items AS MATERIALIZED (SELECT item_id, q, width, array_to_string(own, ' ') AS h, slots, raw[q + 1 : q + width] AS old,
  count(DISTINCT q) OVER (PARTITION BY item_id) AS windows FROM iz WHERE width - len(slots) >= {LITERALS}),
dw AS MATERIALIZED (SELECT doc_id, {_SQL_WORDS} AS raw FROM documents),
dc AS (SELECT doc_id, raw, {_SQL_CANON} AS words FROM dw),
sizes AS (SELECT DISTINCT width FROM items),
dt AS MATERIALIZED (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM dc),
dg AS (SELECT doc_id, pos - 1 AS pos, list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS own FROM dt),
dh AS MATERIALIZED (SELECT doc_id, pos, width, array_to_string(own[1 : width], ' ') AS h FROM dg, sizes WHERE len(own) >= width),
hits AS MATERIALIZED (SELECT doc_id, item_id, pos, q, pos - q AS shift, slots, old, windows FROM dh JOIN items USING (width, h)),
pairs AS (SELECT doc_id, item_id, shift, old[k + 1] AS a, raw[pos + k + 1] AS b
  FROM (SELECT hits.*, unnest(slots) AS k FROM hits) JOIN dw USING (doc_id)),
bad AS (SELECT DISTINCT doc_id, item_id, shift, true AS odd FROM
  (SELECT doc_id, item_id, shift, a FROM pairs GROUP BY ALL HAVING min(b) <> max(b))),
found AS (SELECT doc_id, item_id, count(DISTINCT CASE WHEN odd IS NULL THEN q END) AS matched, max(windows) AS windows,
  max(odd) IS NULL AS consistent FROM hits LEFT JOIN bad USING (doc_id, item_id, shift) GROUP BY doc_id, item_id)
SELECT *, matched / windows AS coverage, matched / windows >= {COVERAGE} AS leaked FROM found WHERE matched / windows >= {COVERAGE}
"""
