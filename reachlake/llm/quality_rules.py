"""Line-first cleaning with DataFrame functions alone: lines are judged one by one, then documents by what they lose.

Each line with a word is held against the rules in this order, and the first that it breaks names the
reason for its removal:

``navigation``   items set apart by two or more bars, arrows or bullets, or at most three words that
                 are all menu words
``boilerplate``  a phrase of cookie, licence, sign-up or script notices
``punctuation``  at least a third of its marks and letters are not letters, digits or sentence marks,
                 or a short line (fewer than ``OPEN_WORDS`` words) that ends without a sentence mark

A document is rejected when more than ``LOST_PERCENT`` of the characters of its words stood in removed
lines. Lines without a word are layout; they stay and never count.

A text is one row and is never taken apart over rows, so nothing is shuffled and a group of equal
documents or a frequent source costs no more than others. Null texts are empty: no words, not kept.
Rows with equal ids are judged each by its own text, a null id is kept as it is, and an empty table
gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.textvec import kept_columns

OPEN_WORDS = 8
LOST_PERCENT = 30
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3

# Symbols and the words and phrases of the rules, in lower case.
SYMBOLS = "#*$%&|<>"
MENU = ["home", "menu", "login", "logout", "register", "search", "next", "previous", "back", "top", "share", "contact",
        "about", "help", "sitemap", "print", "email", "archive", "categories", "tags", "faq", "blog", "news"]
PHRASES = ["all rights reserved", "accept cookies", "use cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use",
           "terms of service", "terms and conditions", "licensed under", "subscribe to", "sign up for", "log in to", "click here",
           "enable javascript", "read more", "share this", "follow us", "skip to content", "powered by", "lorem ipsum", "copyright ("]
SEPARATORS = r"[|\x{00BB}\x{203A}\x{2022}\x{00B7}>]"
NAVIGATION = rf"(^|[ \t]){SEPARATORS}[ \t].*[ \t]{SEPARATORS}([ \t]|$)"
MENU_LINE = rf"^[ \t-\r]*({'|'.join(MENU)})([ \t]+({'|'.join(MENU)})){{0,2}}[ \t-\r]*$"
BOILERPLATE = rf"(^|[^A-Za-z])({'|'.join(p.replace('(', '[(]') for p in PHRASES)})"
# Sentence marks, closed by quotes or brackets.
ENDED = r"(?s)^.*[.!?:;,\x{2026}\x{3002}\x{FF01}\x{FF1F}]['\")\]\x{00BB}\x{201D}\x{2019}]*[ \t-\r]*$"
# All but letters, digits, accents, white space and sentence marks of any script.
ODD = r"[^a-zA-Z0-9 .,;:!?'\"()\t-\r\p{L}\p{N}\p{M}\p{Z}\x{2019}\x{201C}\x{201D}\x{2018}\x{2026}\x{2013}\x{2014}-]+"

GAPS = r"[ \t-\r]+"
# Letters A-Z match in either case, others only as they are.
ANY_CASE = "(?i)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also where a lambda uses it for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of characters other than white space, in order."""
    return F.array_remove(F.split(text, GAPS), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def has_word(text: Column) -> Column:
    return text.rlike(r"[^ \t-\r]")


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that stand in the text twice or more.

    Windows are sorted by a hash; those with a neighbour of the same hash are sorted again by their words.
    """
    n = F.size(words)

    def with_twin(rows, fields):
        def same(x, y):
            equal = x[fields[0]] == y[fields[0]]
            for f in fields[1:]:
                equal = equal & (x[f] == y[f])
            return F.coalesce(equal, F.lit(False))

        return F.filter(rows, lambda x, k: same(x, F.get(rows, k + 1)) | same(x, F.get(rows, k - 1)))

    def hashed(i):
        return F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]).alias("h"), i.alias("at"))

    def spelled(x):
        return F.struct(*[F.get(words, x["at"] + j).alias(f"w{j}") for j in range(WINDOW)], x["at"].alias("at"))

    def count(rows):
        return F.size(F.array_distinct(F.flatten(F.transform(rows, lambda x: F.array(*[x["at"] + j for j in range(WINDOW)])))))

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), hashed))
    likely = _let(windows, lambda rows: with_twin(rows, ["h"]))
    exact = _let(F.sort_array(F.transform(likely, spelled)), lambda rows: with_twin(rows, [f"w{j}" for j in range(WINDOW)]))
    return F.when(n >= WINDOW, count(exact)).otherwise(F.lit(0)).cast("long")


def line_fault(line: Column) -> Column:
    """The rule that a line breaks, or null; lines without a word break none."""

    def judge(t):
        odd = F.length(t) - F.length(F.regexp_replace(t, ODD, ""))
        marked = _let(odd, lambda n: (n > 0) & (3 * n >= word_chars(words_of(t))))
        return (
            F.when(~has_word(t), F.lit(None))
            .when(t.rlike(NAVIGATION) | t.rlike(ANY_CASE + MENU_LINE), F.lit("navigation"))
            .when(t.rlike(ANY_CASE + BOILERPLATE), F.lit("boilerplate"))
            .when(marked | (~t.rlike(ENDED) & (F.size(words_of(t)) < OPEN_WORDS)), F.lit("punctuation"))
        )

    return _let(line, judge)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Counts, cleaned text and verdict of every row.

    Columns: the id; ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the text;
    ``base_failed``; ``removed``, an array of ``(line, rule)`` with line numbers from 0; ``lost_chars``,
    the characters of words in removed lines; ``cleaned``, the text without them; ``kept``. ``keep``
    maps names of the result to further columns of ``docs``.
    """
    rows = kept_columns(docs, {"_id": id_col, "_text": text_col, **(keep or {})})
    text = F.coalesce(F.col("_text"), F.lit(""))
    words = _let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))

    def judged(lines):
        faults = F.transform(lines, lambda x: F.struct(x.alias("text"), line_fault(x).alias("rule")))
        worded = F.filter(lines, has_word)
        return F.struct(
            (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
            _let(faults, lambda f: F.struct(
                F.concat_ws("\n", F.transform(F.filter(f, lambda x: x["rule"].isNull()), lambda x: x["text"])).alias("cleaned"),
                F.aggregate(F.filter(f, lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"),
                            lambda n, x: n + word_chars(words_of(x["text"]))).alias("lost_chars"),
                F.filter(F.transform(f, lambda x, i: F.struct(i.alias("line"), x["rule"].alias("rule"))),
                         lambda x: x["rule"].isNotNull()).alias("removed"))).alias("by_line"))

    told = rows.select(
        F.col("_id"), *(keep or {}),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        words.alias("_w"), _let(F.split(text, "\n", -1), judged).alias("_l"))
    failed = (F.col("_w.n_words") < LEAST_WORDS) | (100 * F.col("_w.n_repeat_words") > REPEAT_PERCENT * F.col("_w.n_words"))
    lost = F.col("_l.by_line.lost_chars")
    return told.select(
        F.col("_id").alias(id_col), "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
        failed.alias("base_failed"), (~failed & (100 * lost <= LOST_PERCENT * F.col("_w.word_chars"))).alias("kept"),
        lost.alias("lost_chars"), F.col("_l.by_line.removed").alias("removed"), F.col("_l.by_line.cleaned").alias("cleaned"),
        *(keep or {}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "lost_chars", F.size("removed").cast("long").alias("n_removed_lines"), F.sha2("cleaned", 256).alias("cleaned_sha256"))


def _sql() -> str:
    def q(s):
        return s.replace("'", "''")

    blank = r"[ \t-\r]"
    return rf"""
with docs as (select row_number() over () k, doc_id, coalesce(text, '') as t from documents),
words as (select k, w, p from (select k, unnest(l) w, generate_subscripts(l, 1) p
    from (select k, regexp_extract_all(t, '[^ \t-\r]+') l from docs))),
n_words as (select k, count(*) n from words group by k),
windows as (select k, p, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o g from words window o as (partition by k order by p)),
twice as (select k, unnest([p, p + 1, p + 2]) p from (
    select k, p, count(*) over (partition by k, g) c from windows where g is not null) where c > 1),
n_repeat as (select k, count(distinct p) n from twice group by k),
lines as (select k, unnest(l) x, generate_subscripts(l, 1) p from (select k, string_split(t, chr(10)) l from docs)),
judged as (select k, p, x, s, length(regexp_replace(s, '{blank}', '', 'g')) chars, case when s = '' then null
    when regexp_matches(s, '{q(NAVIGATION)}') or regexp_matches(low, '{q(MENU_LINE)}') then 'navigation'
    when regexp_matches(low, '{q(BOILERPLATE)}') then 'boilerplate'
    when (odd > 0 and 3 * odd >= length(regexp_replace(s, '{blank}', '', 'g')))
      or (len(regexp_extract_all(s, '[^ \t-\r]+')) < {OPEN_WORDS} and not regexp_matches(s, '{q(ENDED)}')) then 'punctuation' end as rule
    from (select *, length(s) - length(regexp_replace(s, '{q(ODD)}', '', 'g')) odd,
        translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from (
        select *, regexp_replace(regexp_replace(x, '^{blank}+', ''), '{blank}+$', '') s from lines))),
by_line as (select k, count(*) filter (s <> '') - count(distinct x) filter (s <> '') dup, coalesce(sum(chars) filter (rule is not null), 0) lost,
    count(rule) removed, coalesce(string_agg(x, chr(10) order by p) filter (rule is null), '') cleaned from judged group by k),
told as (select doc_id, coalesce(n_words.n, 0) n_words, length(regexp_replace(t, '{blank}', '', 'g')) word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) n_symbols, dup n_dup_lines, coalesce(n_repeat.n, 0) n_repeat_words, lost, removed, cleaned
    from docs left join n_words using (k) left join n_repeat using (k) join by_line using (k)),
failed as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words base_failed from told)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and 100 * lost <= {LOST_PERCENT} * word_chars kept, cast(lost as bigint) lost_chars, removed n_removed_lines,
    sha256(cleaned) cleaned_sha256 from failed"""


SQL = _sql()
