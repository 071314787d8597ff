"""Personal data and the terms that give it away.

Spans of four kinds are found by pattern. Then corpus co-occurrence tells which terms reveal a protected value: if
most of a term's occurrences in the whole corpus stand beside one value, in several unrelated documents, the
term discloses that value and is generalised or removed as well. Most values occur once, so evidence is also
pooled over a kind: where most occurrences of a term announce a long run of mixed letters and digits, what
it announces is a protected value and goes. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmat.llm.frames import apart, text_or_empty
from kinmat.llm.frames import let as _let
from kinmat.session import settle

#: Words on either side of a value that count as beside it, and the characters they are looked for in.
WINDOW_WORDS = 8
WINDOW_CHARS = 200
#: Documents without a common least hash of three words in which a term must stand beside a value.
LEAST_GROUPS = 2
#: Shares of a term's occurrences beside one value from which it is generalised, and removed.
GENERALISE_FROM, REMOVE_FROM = 0.5, 0.8
#: What a term is made of: letters and digits, however few.
TERM_PART = r"[\p{L}\p{N}]"

# The patterns of the four kinds. Where nothing but the quantified part can follow, quantifiers are
# possessive, and a look-behind (or the end of the last match) bars starts inside a run, so long runs are read once.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: In the order in which spans with the same start are listed.
KINDS = [*PATTERNS, "term"]
#: Letters and digits of an opaque value, and what may stand between it and the term that announces it.
OPAQUE_LENGTH = 16
_OPAQUE = rf"(?=\p{{L}}*\p{{N}})(?=\p{{N}}*\p{{L}}){TERM_PART}{{{OPAQUE_LENGTH},}}+"
_GAP = r"[^\p{L}\p{N}]{1,8}+"
_ANNOUNCED = rf"(?<!{TERM_PART})({TERM_PART}++){_GAP}(?={_OPAQUE})"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Entries that a running sum takes together, and code points of the pieces that texts are read in.
BLOCK, CHUNK = 64, 256

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL_MASK, REMOVED_MASK = "[TERM]", ""


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits, every second one from the right doubled, sum up to a multiple of ten."""
    backwards = F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != "")
    parts = F.transform(
        backwards,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


# What any match of a kind holds, cheap to look for; most texts hold none of it.
NEEDED = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: F.rlike(text, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda text: F.rlike(text, F.lit("[0-9][0-9\\x20-][0-9]")),
    "phone": lambda text: F.contains(text, F.lit("+")),
}

VALID = {
    "email": lambda span: F.lit(True),
    "ip": lambda span: span["value"].rlike(_IP),
    "card": lambda span: F.length(_digits(span["value"])).between(14, 19) & _luhn(span["value"]),
    "phone": lambda span: F.length(_digits(span["value"])).between(10, 15),
}


def _running(values: Column, op, zero: Column) -> Column:
    """For each entry, what ``op`` makes of all entries before it.

    Sums within blocks, then over blocks, so that n entries take n * BLOCK / 2 steps and (n / BLOCK) ** 2 / 2 more.
    """

    def folded(part: Column) -> Column:
        return F.aggregate(part, zero, op)

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, folded)

        def placed(totals: Column) -> Column:
            return F.flatten(
                F.transform(
                    blocks,
                    lambda block, k: _let(
                        folded(F.slice(totals, F.lit(1), k)),
                        lambda before: F.transform(block, lambda _, i: op(before, folded(F.slice(block, F.lit(1), i)))),
                    ),
                )
            )

        return _let(totals, placed)

    def of_values(entries: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(entries), F.lit(BLOCK))
        return F.when(F.size(entries) > 0, _let(F.transform(firsts, lambda i: F.slice(entries, i, F.lit(BLOCK))), of_blocks)).otherwise(F.slice(entries, 1, 0))

    return _let(values, of_values)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def pattern_spans(text: Column, pattern: Column, kind: str) -> Column:
    """All leftmost matches with their places in code points, as an array of spans."""
    empty = F.array().cast(f"array<{SPAN}>")
    rank = F.lit(KINDS.index(kind))
    # The text after the last match has no match to go with it.
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def spans(found: Column, gaps: Column, before: Column) -> Column:
        def span(match: Column, i: Column) -> Column:
            return _let(
                F.get(before, i) + F.get(gaps, i),
                lambda first: F.struct(
                    first.alias("start"), rank.alias("rank"), (first + F.length(match)).alias("end"), F.lit(kind).alias("kind"), match.alias("value")
                ),
            )

        return F.transform(found, span)

    def placed(found: Column) -> Column:
        return _let(
            gaps,
            lambda g: _let(
                _running(F.transform(found, lambda m, i: F.length(m) + F.get(g, i)), _plus, F.lit(0)), lambda before: spans(found, g, before)
            ),
        )

    return F.when(F.rlike(text, pattern), _let(F.regexp_extract_all(text, pattern, 0), placed)).otherwise(empty)


def _chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)


def _piece(chunks: Column, start: Column, length: Column) -> Column:
    """``substring`` from a place counted from 0, without walking the text from its beginning."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((start + length) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, length)


def base_spans(text: Column) -> Column:
    """The valid spans of the four kinds, by start and then kind; kinds may overlap."""
    found = []
    for kind, pattern in PATTERNS.items():
        spans = F.filter(pattern_spans(text, F.lit(pattern), kind), VALID[kind])
        found.append(F.when(NEEDED[kind](text), spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.array_sort(F.concat(*found))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{TERM_PART}){TERM_PART}++"), 0)


def _group(words: Column) -> Column:
    """The least hash of three words in a row, which copies mostly share."""
    return _let(words, lambda w: F.array_min(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("__key_1__"), F.xxhash64(F.lit("second"), "text").alias("__key_2__")]


def co_occurrences(texts: DataFrame) -> DataFrame:
    """value, term, beside (occurrences of the term beside the value), n_groups (unrelated documents it has them in)."""
    held = texts.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)

    def beside(chunks: Column, span: Column) -> Column:
        first = F.greatest(span["start"] - WINDOW_CHARS, F.lit(0))
        before = _words(_piece(chunks, first, span["start"] - first))
        after = _words(_piece(chunks, span["end"], F.lit(WINDOW_CHARS)))
        near = _let(before, lambda w: F.slice(w, F.greatest(F.size(w) - WINDOW_WORDS + 1, F.lit(1)), WINDOW_WORDS))
        written = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(_digits(span["value"]))
        return F.struct(F.xxhash64(span["kind"], written).alias("value"), F.concat(near, F.slice(after, 1, WINDOW_WORDS)).alias("terms"))

    near = _let(_chunks(F.col("text")), lambda chunks: F.transform("spans", lambda span: beside(chunks, span)))
    # What stands beside a generator is evaluated for each of its rows, so the group is made first.
    found = held.select(_group(_words(F.col("text"))).alias("group"), near.alias("near"))
    rows = found.select("group", F.explode("near").alias("near")).select("group", "near.value", F.explode("near.terms").alias("term"))
    return (
        rows.groupBy("value", "term", "group")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value", "term")
        .agg(F.sum("n").alias("beside"), F.count(F.lit(1)).alias("n_groups"))
    )


def _announces(text: Column) -> Column:
    """Whether the text has an opaque value after a term; one has a digit, which is cheap to look for."""
    return F.rlike(text, F.lit("[0-9]")) & F.rlike(text, F.lit(_ANNOUNCED))


def announced_values(texts: DataFrame) -> DataFrame:
    """cue, group, n: how often a term is followed by an opaque value, for each least hash of a text's runs of words.

    An opaque value is a run of at least OPAQUE_LENGTH letters and digits that has both, as keys, tokens and
    account codes have; there is little but its own entropy to tell it by.
    """
    pairs = F.when(_announces(F.col("text")), F.regexp_extract_all("text", F.lit(_ANNOUNCED), 1)).otherwise(F.array().cast("array<string>"))
    held = texts.select("text", pairs.alias("cues")).where(F.size("cues") > 0)
    grouped = held.select(_group(_words(F.col("text"))).alias("group"), "cues")
    rows = grouped.select("group", F.explode("cues").alias("cue")).withColumn("cue", F.lower("cue"))
    return rows.groupBy("cue", "group").agg(F.count(F.lit(1)).alias("n"))


def _occurrences(texts: DataFrame) -> DataFrame:
    """word (a hash) and n: occurrences of every term in the whole corpus, counted within each task first."""
    return (
        texts.select(F.explode(_words(F.col("text"))).alias("term"))
        .select(F.xxhash64("term").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _strong(candidates: DataFrame, everywhere: DataFrame) -> DataFrame:
    """term and share: candidates (term, beside) at least GENERALISE_FROM of whose occurrences are ``beside``."""
    share = F.least(F.col("beside") / F.col("n"), F.lit(1.0))
    joined = candidates.withColumn("word", F.xxhash64("term")).join(everywhere, "word")
    return joined.select("term", share.alias("share")).where(F.col("share") >= GENERALISE_FROM)


def _candidates(texts: DataFrame) -> DataFrame:
    beside = co_occurrences(texts).where(F.col("n_groups") >= LEAST_GROUPS)
    return beside.groupBy("term").agg(F.max("beside").alias("beside"))


def _cue_candidates(texts: DataFrame) -> DataFrame:
    pooled = announced_values(texts).groupBy("cue").agg(F.sum("n").alias("beside"), F.count(F.lit(1)).alias("n_groups"))
    return pooled.where(F.col("n_groups") >= LEAST_GROUPS).select(F.col("cue").alias("term"), "beside")


def disclosing_terms(texts: DataFrame) -> DataFrame:
    """term and share for terms of which at least ``GENERALISE_FROM`` of all occurrences stand beside one value.

    Occurrences are counted over the whole corpus, first within each task. A term must stand beside the
    value in ``LEAST_GROUPS`` groups of documents; copies, which mostly share the least
    hash of three words in a row, are one group.
    """
    return _strong(settle(_candidates(texts)), _occurrences(texts))


def announcing_terms(texts: DataFrame) -> DataFrame:
    """term and share for terms of which at least ``GENERALISE_FROM`` of all occurrences announce an opaque value.

    Each opaque value is mostly unique, so evidence is pooled over all of them: what a term reveals is that a
    protected value of this kind follows. As with ``disclosing_terms``, ``LEAST_GROUPS`` groups of documents are needed.
    """
    return _strong(settle(_cue_candidates(texts)), _occurrences(texts))


def _term_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both kinds of terms from one count of all words."""
    kinds = F.lit(True).alias("announces"), F.lit(False).alias("announces")
    both = settle(_cue_candidates(texts).select("*", kinds[0]).unionByName(_candidates(texts).select("*", kinds[1])))
    counted = both.withColumn("word", F.xxhash64("term")).join(_occurrences(texts), "word")
    share = F.least(F.col("beside") / F.col("n"), F.lit(1.0))
    found = settle(counted.select("term", "word", "announces", share.alias("share")).where(F.col("share") >= GENERALISE_FROM))
    return found.where("not announces").drop("announces"), found.where("announces").drop("announces")


def _held_terms(texts: DataFrame, terms: DataFrame, cues: DataFrame) -> DataFrame:
    """Two hashes of a text, and the spans of disclosing terms and announced values in it.

    Only texts with such a term have the places of their words worked out; those are joined one by one, so
    neither a long text nor a long list of terms makes a pattern of its own.
    """
    worded = texts.select(*_text_key(), "text")
    keys = ["__key_1__", "__key_2__"]
    touched = settle(
        worded.select(*keys, F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
        .select(*keys, F.xxhash64("term").alias("word"))
        .join(terms, "word", "left_semi")
        .select(*keys)
        .distinct()
    ).withColumn("__touched__", F.lit(True))
    spans = pattern_spans(F.col("text"), F.lit(rf"{TERM_PART}++"), "term")
    # A word announces the next one if that is opaque and near.
    opaque = F.lit(f"^(?:{_OPAQUE})$")

    def place(words: Column) -> Column:
        def named(span: Column, i: Column) -> Column:
            before = F.get(words, i - 1)
            near = (i > 0) & (span["start"] - before["end"] <= 8) & F.rlike(span["value"], opaque)
            cue = F.when(near, F.xxhash64(F.lower(before["value"])))
            return F.struct(span.alias("span"), F.lower(span["value"]).alias("term"), cue.alias("cue"))

        return F.transform(words, named)

    chosen = worded.join(touched, keys, "left").where(F.col("__touched__") | _announces(F.col("text")))
    placed = chosen.select(*keys, F.explode(_let(spans, place)).alias("at"))
    own = terms.select("word", F.col("term").alias("__term__"), F.col("share").alias("__share__"))
    after = cues.select(F.col("word").alias("cue"), F.col("share").alias("__cued__"))
    found = (
        placed.select("*", F.xxhash64("at.term").alias("word"), "at.cue")
        .join(own, ["word"], "left")
        .join(after, "cue", "left")
        .withColumn("share", F.greatest(F.when(F.col("__term__") == F.col("at.term"), F.col("__share__")), "__cued__"))
        .where("share IS NOT NULL")
    )
    rank = F.lit(KINDS.index("term")) + (F.col("share") >= REMOVE_FROM).cast("int")
    span = F.col("at.span").withField("rank", rank)
    return found.groupBy(*keys).agg(F.collect_set(span).alias("__terms__"))


def find_spans(docs: DataFrame) -> DataFrame:
    """Add ``base_spans`` and ``spans``: arrays of (start, rank, end, kind, value), places in code points, end exclusive.

    A null text is empty. ``spans`` also has the disclosing terms, wherever they stand, and the opaque values that an announcing
    term stands before, as kind term; one to be removed has a rank one higher. Other columns stay, repeated rows too; columns with
    these names are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "spans", "text")]
    body = text_or_empty()
    texts = docs.select(body.alias("text"))
    held = settle(_held_terms(texts, *_term_tables(texts)))
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], body.alias("text")).select("*", *_text_key())
    joined = keyed.join(held, ["__key_1__", "__key_2__"], "left")
    based = joined.withColumn("base_spans", base_spans(F.col("text")))
    added = F.coalesce("__terms__", F.array().cast(f"array<{SPAN}>"))
    return based.withColumn("spans", F.array_sort(F.concat("base_spans", added))).select(*kept, "text", "base_spans", "spans")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with every span masked by its kind, and disclosing terms generalised or removed.

    Columns and rows stay; where spans overlap, the first one's mask stands for all of them. A text without a span is
    as it was, a null text too.
    """
    plain, named = apart(docs, ("text",))
    found = find_spans(plain.withColumn("__null__", F.col("text").isNull()))
    rank = KINDS.index("term")
    mask = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])

    def masked(chunks: Column, spans: Column, ends: Column) -> Column:
        def shown(span: Column, i: Column) -> Column:
            end = F.get(ends, i)
            cover = F.when(span["rank"] > rank, REMOVED_MASK).when(span["rank"] == rank, GENERAL_MASK).otherwise(mask[span["kind"]])
            return F.when(span["start"] >= end, F.concat(_piece(chunks, end, span["start"] - end), cover)).otherwise("")

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(spans, shown), ""), F.substring(F.col("text"), last + 1, F.length("text")))

    def with_ends(spans: Column) -> Column:
        return _let(
            _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)),
            lambda ends: _let(_chunks(F.col("text")), lambda chunks: masked(chunks, spans, ends)),
        )

    text = F.when(F.size("spans") > 0, _let(F.col("spans"), with_ends)).when(~F.col("__null__"), F.col("text"))
    return named(found.withColumn("text", text))
