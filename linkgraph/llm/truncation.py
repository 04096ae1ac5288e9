"""Texts cut off by field limits or in transfer.

Found by a self-join by prefix: a text is cut where what it ends with is a strict prefix of a longer
copy elsewhere and is no whole copy of anything. Five kinds of values are compared, all in one sort
by ranges: whole texts, last sentences (names and digits made alike), last pairs of words, last words
and the first words of sentences. A value is a strict prefix of some other one if and only if it is one of its successor.
Texts that end with a full stop or the like, markup after it aside, are whole, unless a longer copy
of all of the text exists and its length is a limit at which texts of its source pile up.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import checkpointed, shuffle_width, small_or_shuffled

#: A length of a source is a limit if at least so many texts have it, and so many times more than the lengths around it.
PILE_ROWS, PILE_TIMES, PILE_AROUND = 5, 8, 20
#: ... and if this share of them end openly.
PILE_OPEN = 0.3
#: A sentence or word counts as whole from this share of all texts on, a pair of words and first words from this share of their places.
WHOLE_SHARE, PAIR_SHARE = 1e-6, 0.01
#: The first words of sentences that are values of their own: so many at most.
FIRST_WORDS = 2
#: Distinct values that a task gathers before it sends their counts on.
HELD = 300_000
#: Rows of one range of the sort.
RANGE_ROWS = 500_000
#: Lengths of the prefixes by which texts are told apart before they are compared.
PREFIX_CHARS = tuple(4**i for i in range(16))

REASONS = ("mark", "longer copy", "word", "sentence", "pair", "first words", "limit")

_MARK = regex.compile(r"(?r)\s*(?:[\[(]\s*(?:…|\.{3})\s*[\])]|…|\.{3}|&hellip;|\N{REPLACEMENT CHARACTER}+)\s*")
_STOPS = frozenset(".!?。！？")
_CLOSERS = frozenset("\"'»”’") | {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Pf", "Pe")}
_SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
_INLINE = "ref|span|small|sup|sub|math|code|nowiki|font|a|b|i|u|em|strong"
#: Pieces of markup and signs that may follow the end of a text, by the sign that they end with, each matched backwards from the end.
_AFTER = {
    end: [regex.compile(rf"(?r)(?:{p})", regex.S) for p in patterns]
    for end, patterns in {
        ">": (r"</[A-Za-z][^<>]*>", r"<[^<>]*/>", r"<br[^<>]*>", r"<!--(?:(?!-->).)*-->", rf"<(?:{_INLINE})\b(?:[^<>]|<[^<>]*>)*>[^<>]*</(?:{_INLINE})>"),
        "}": (r"\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}", r"~?\\[a-z]+(?:\{[^{}]*\})+"),
        "]": (r"\[\[[^\[\]]*\]\]", r"\[https?://[^\[\]]*\]"),
        ")": (r"!?\[[^\[\]]*\]\([^()]*\)", r"\\\([^\n]*?\\\)"),
        "$": (r"\$[^$\n]+\$",), ";": (r"&\#?\w+;",), "~": (r"~~[^~\n]*~~", "~~"), "*": (r"\*\*[^*\n]*\*\*", r"\*\*"), "'": (r"'{2,3}[^'\n]*'{2,3}",), "`": (r"`[^`\n]*`",), "_": (r"__\S*__", "__"),
    }.items()
}
_SIGNS_AFTER = [regex.compile(rf"(?r)(?:{p})") for p in (r"(?<=。) [\p{Latin}’']+", r"[\p{So}\p{Sk}\p{Cf}✓️]", r"\s\d+(?:\.\d+)?(?:e-?\d+)?")]
_INNER = regex.compile(r"(?r)(?:</[A-Za-z][^<>]*>|\}|\*\*|~~|''+|`)+")
_SIGNED = regex.compile(r"--? .*\p{L}, \d{1,2} \p{Lu}\p{L}{2,}(?: \d{4})?")
_SENTENCES = regex.compile(r"\n|[.!?][\p{Pf}\p{Pe}\"'»”’]?\K\s+(?=\p{Lu}|\p{Lo})|[。！？]\K")
_WORD = regex.compile(r"[\p{L}\p{M}]++")
_LAST_WORD = regex.compile(r"(?r)[\p{L}\p{M}]+")
_NAME = regex.compile(r"\p{Lu}[\p{Lu}\p{Ll}\p{Lm}\p{M}’'–-]*")
_DIGIT = regex.compile(r"\d")
_OWN = regex.compile(r"[\p{Ll}\p{Lo}0]")


def alike(text: str) -> str:
    """text with its names and digits made alike."""
    return _DIGIT.sub("0", _NAME.sub("N", text))


def _end_before(text: str, end: int, signs) -> int:
    """Where text[:end] ends if the signs (a test of one character) at its end are taken off."""
    while end and signs(text[end - 1]):
        end -= 1
    return end


def _closes(text: str, end: int) -> bool:
    end = _end_before(text, end, _CLOSERS.__contains__)
    return end > 0 and text[end - 1] in _STOPS


def ending(text: str) -> tuple[str, int]:
    """How a text ends (marked, closed, open or blank), and where, a mark of a cut taken off."""
    end = _end_before(text, len(text), str.isspace)
    if not end:
        return "blank", 0
    if (m := _MARK.match(text, 0, end)) and m.start() < end:
        return "marked", m.start()
    if _closes(text, end) or _SIGNED.fullmatch(text, text.rfind("\n", 0, end) + 1, end):
        return "closed", end
    inner = _INNER.match(text, 0, end)
    if inner and _closes(text, inner.start()):
        return "closed", end
    bare = end
    while bare:
        patterns = _AFTER.get(text[bare - 1], ()) or _SIGNS_AFTER
        at = min((m.start() for m in (p.match(text, 0, bare) for p in patterns) if m), default=bare)
        if at == bare:
            break
        bare = _end_before(text, at, str.isspace)
        if _closes(text, bare):
            return "closed", end
    return "open", end


def sentences(text: str) -> list[tuple[str, str]]:
    """The sentences and lines of a text as they are and with names and digits made alike, blanks at their ends taken off."""
    return [(x, alike(x)) for x in (s.strip() for s in _SENTENCES.split(text)) if x]


def _sentence_key(sentence: str, source: str | None) -> str:
    """A sentence with a word or figure of its own is one everywhere, one of names only in its source."""
    return f"s\t{sentence}" if _OWN.search(sentence) else f"s\t{source or ''}\t{sentence}"


def last_values(text: str, source: str | None) -> list[str]:
    """The values that a text ends with: its last sentence, pair of words and word; and the last sentence as it is if it has but few words."""
    said = sentences(text)
    if not said:
        return []
    raw, shape = said[-1]
    out = [_sentence_key(shape, source)]
    words = shape.split()
    if len(words) <= FIRST_WORDS:
        out.append("f\t" + " ".join(raw.split()))
    if len(words) > 1:
        out.append(f"p\t{words[-2]} {words[-1]}")
    word = _LAST_WORD.match(text, 0, _end_before(text, len(text), str.isspace))
    if word:
        out.append(f"w\t{word[0]}")
    return out


def _facts(documents: DataFrame) -> DataFrame:
    """One pass over the texts: a row for each text, and counts of the values in them.

    value, n_more, n_whole: how often more follows a value, and how often it is whole.
    """
    schema = "doc_id bigint, source string, n_chars bigint, ending string, lasts array<string>, value string, n_more bigint, n_whole bigint"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()]
    names = ["doc_id", "source", "n_chars", "ending", "lasts", "value", "n_more", "n_whole"]

    def rows(tuples: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*tuples, strict=True), kinds, strict=True)], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: defaultdict[str, int] = defaultdict(int)
        whole: defaultdict[str, int] = defaultdict(int)

        def counts() -> list[tuple]:
            out = [(None, None, None, None, None, v, more.get(v, 0), whole.get(v, 0)) for v in more.keys() | whole.keys()]
            more.clear()
            whole.clear()
            return out

        def take_in(text: str, source: str | None, closed: bool) -> None:
            said = sentences(text)
            for i, (raw, shape) in enumerate(said):
                words = shape.split()
                first = raw.split(None, FIRST_WORDS)
                for pair in zip(words[:-2], words[1:-1], strict=False):
                    more["p\t" + " ".join(pair)] += 1
                for k in range(1, min(len(first), FIRST_WORDS + 1)):
                    more["f\t" + " ".join(first[:k])] += 1
                if closed or i + 1 < len(said):
                    whole[_sentence_key(shape, source)] += 1
                    if len(words) > 1:
                        whole[f"p\t{words[-2]} {words[-1]}"] += 1
                    if len(first) <= FIRST_WORDS:
                        whole["f\t" + " ".join(first)] += 1
            every = _WORD.findall(text)
            if every and text.endswith(every[-1]):  # what the text ends with may be no whole word
                every.pop()
            for w in set(every):
                whole["w\t" + w] += 1

        for b in batches:
            out = []
            for i, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                how, end = ending(t)
                bare = t[:end]
                out.append((i, s, len(t), how, last_values(bare, s) if how in ("open", "marked") else None, None, None, None))
                if how != "blank":
                    take_in(bare, s, how == "closed")
            if out:
                yield rows(out)
            if len(more) + len(whole) > HELD:
                yield rows(counts())
        if more or whole:
            yield rows(counts())

    return documents.where("text is not null").select("doc_id", "source", "text").mapInArrow(gather, schema)


def text_key(c: Column) -> Column:
    """Two 64-bit hashes as a key of a text."""
    return F.concat_ws("-", F.xxhash64(c), F.xxhash64(F.lit(7), c))


def alike_at_front(texts: DataFrame) -> DataFrame:
    """key of those of the distinct texts (key, text) that may be a strict prefix of another or have one.

    Only hashes of prefixes are shuffled. A text is hashed at its own length (the longest of
    PREFIX_CHARS that it reaches) and, as it may be the longer one, at all shorter ones; a group of
    equal prefixes is of use if it holds a text of that own length and a longer text.
    """
    schema = "key string, n int, front bigint, own boolean"

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, length, front, own = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                n = len(t)
                sizes = [p for p in PREFIX_CHARS if p <= n]
                at += [i] * len(sizes)
                length += [n] * len(sizes)
                front += [xxhash.xxh3_64_intdigest(t[:p].encode(), p & 0xFFFFFFFF) - (1 << 63) for p in sizes]
                own += [p == sizes[-1] for p in sizes]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(length, pa.int32()), pa.array(front, pa.int64()), pa.array(own, pa.bool_())], names=["key", "n", "front", "own"])

    rows = checkpointed(texts.select("key", "text").mapInArrow(fronts, schema))
    groups = rows.groupBy("front").agg(F.max("n").alias("longest"), F.min(F.when(F.col("own"), F.col("n"))).alias("shortest")).where("shortest < longest").select("front")
    return join_unique(rows, checkpointed(groups), "front").select("key").distinct()


def prefix_hits(values: DataFrame) -> DataFrame:
    """key of the values (key, value, asked; distinct) that are asked and strict prefixes of another one.

    The values are sorted by ranges in descending order, so each meets its successor; only the first
    value of a range must look at the range before, which two rows a range tell.
    """
    schema = "key string, is_prefix boolean, part int, first string, last string"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = before = None
        for b in batches:
            keys = []
            for key, v, asked in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if before is None:
                    first = (key if asked else None, v)
                elif asked and before.startswith(v):
                    keys.append(key)
                before = v
            k = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([True] * k, pa.bool_()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string())], names=["key", "is_prefix", "part", "first", "last"])
        if first is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([first[0]], pa.string()), "is_prefix": [False], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first[1]], "last": [before]})

    ranges = max(shuffle_width(values.sparkSession), values.count() // RANGE_ROWS)
    in_order = values.select("key", "value", "asked").repartitionByRange(ranges, F.col("value").desc()).sortWithinPartitions(F.col("value").desc())
    told = checkpointed(in_order.mapInArrow(compare, schema))
    # Two values a range: as many rows as there are ranges.
    ends = told.where("part is not null").withColumn("greater", F.lag("last").over(Window.orderBy("part")))
    return told.where("is_prefix").select("key").unionByName(ends.where(F.col("key").isNotNull() & F.startswith("greater", "first")).select("key"))


def _texts_in_question(texts: DataFrame) -> DataFrame:
    """key, value, asked of the distinct texts that share a front with another one."""
    keyed = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).select(text_key(F.col("text")).alias("key"), "text")
    some = checkpointed(alike_at_front(keyed))
    shared = keyed.join(small_or_shuffled(some, some.count()), "key", "left_semi").dropDuplicates(["key"])
    return shared.select("key", F.concat(F.lit("t\t"), "text").alias("value"), F.lit(True).alias("asked"))


def strict_prefixes(texts: DataFrame) -> DataFrame:
    """key (text_key) of the distinct texts (text STRING) that are strict prefixes of another one.

    Empty and null texts take no part.
    """
    return prefix_hits(checkpointed(_texts_in_question(texts)))


def _stem() -> Column:
    return F.rtrim(F.col("text"), F.lit(_SPACES))


def prefix_documents(documents: DataFrame, others: DataFrame) -> DataFrame:
    """doc_id of the documents whose text, blanks at its end aside, is a strict prefix of another text."""
    longer = checkpointed(strict_prefixes(documents.select(_stem().alias("text")).unionByName(others.select("text"))))
    keyed = checkpointed(documents.where("text is not null").select("doc_id", text_key(_stem()).alias("key")))
    return join_unique(keyed, longer, "key").select("doc_id")


def find_cut(documents: DataFrame, others: DataFrame) -> DataFrame:
    """doc_id, source, n_chars, reason of all documents; reason is null where a text is whole.

    documents: doc_id (unique), source, text; others: text of further tables in which longer copies
    of whole texts may lie. Null, empty and blank texts are whole. reason tells which value is the
    strict prefix: "longer copy" (all of the text), sentence, pair, word or first words; or mark (a mark of a cut
    after a prefix of whatever kind) or limit (a text of a usual length after a prefix, even one that
    is whole elsewhere).
    """
    facts = checkpointed(_facts(documents))
    texts = facts.where("doc_id is not null or ending is not null")
    n_texts = texts.where("ending <> 'blank'").count()
    values = facts.where("value is not null").groupBy("value").agg(F.sum("n_more").alias("n_more"), F.sum("n_whole").alias("n_whole"))
    asked = checkpointed(texts.where("lasts is not null").select("doc_id", F.explode("lasts").alias("value")))
    unique = asked.select("value").distinct()

    # One sort for the values of all kinds; the first two characters keep the kinds apart.
    short = values.select("value", F.lit(False).alias("asked")).unionByName(unique.select("value", F.lit(True).alias("asked"))).groupBy("value").agg(F.bool_or("asked").alias("asked"))
    whole_texts = documents.select(_stem().alias("text")).unionByName(others.select("text"))
    hits = checkpointed(prefix_hits(checkpointed(short.select(F.col("value").alias("key"), "value", "asked").unionByName(_texts_in_question(whole_texts)))))

    kind = F.substring("value", 1, 1)
    share = F.col("n_whole") / (F.col("n_more") + F.col("n_whole"))
    enough = F.when(kind == "p", share >= PAIR_SHARE).otherwise(F.col("n_whole") >= WHOLE_SHARE * n_texts)
    judged = (
        unique.join(values, "value", "left").join(hits.select(F.col("key").alias("value"), F.lit(True).alias("hit")), "value", "left")
        .select("value", (F.coalesce("hit", F.lit(False)) | (F.coalesce("n_more", F.lit(0)) > 0)).alias("hit"), F.coalesce((F.col("n_whole") > 0) & enough, F.lit(False)).alias("whole"), F.coalesce("n_more", F.lit(0)).alias("n_more"), F.coalesce("n_whole", F.lit(0)).alias("n_whole"))
    )
    known = join_unique(asked, checkpointed(judged), "value").groupBy("doc_id").agg(
        F.bool_or("hit").alias("any_hit"),
        *(F.bool_or(F.when(kind == k, F.col("hit") & ~F.col("whole"))).alias(f"cut_{k}") for k in "spw"),
        F.bool_or(F.when(kind == "s", F.col("whole"))).alias("whole_s"), F.max(F.when(kind == "s", F.col("n_whole"))).alias("n_whole_s"), F.max(F.when(kind == "p", F.col("n_more"))).alias("n_more_p"),
        F.bool_or(F.when(kind == "f", F.col("n_whole") + 1 < PAIR_SHARE * F.col("n_more"))).alias("cut_f"),
    )

    keyed = checkpointed(documents.where("text is not null").select("doc_id", text_key(_stem()).alias("key")))
    longer = join_unique(keyed, hits, "key").select("doc_id", F.lit(True).alias("has_longer"))
    lengths = texts.where("ending <> 'blank'").groupBy("source", "n_chars").agg(F.count("*").alias("n"), F.count_if(F.col("ending") == "open").alias("n_open"))
    around = Window.partitionBy("source").orderBy("n_chars").rangeBetween(-PILE_AROUND, PILE_AROUND)
    usual = (F.sum("n").over(around) - F.col("n")) / (2 * PILE_AROUND)
    piles = checkpointed(lengths.withColumn("usual", usual).where((F.col("n") >= PILE_ROWS) & (F.col("n") >= PILE_TIMES * F.greatest("usual", F.lit(0.25))) & (F.col("n_open") >= PILE_OPEN * F.col("n"))).select("source", "n_chars", F.lit(True).alias("at_limit")))

    told = texts.select("doc_id", "source", "n_chars", "ending").join(known, "doc_id", "left").join(longer, "doc_id", "left").join(small_or_shuffled(piles, piles.count()), ["source", "n_chars"], "left")
    open_ = F.col("ending") == "open"
    # A sentence that a line break once cut short is still no whole one where its last pair goes on nearly always.
    rarely_whole = F.col("n_whole_s") + 1 < PAIR_SHARE * F.col("n_more_p")
    reason = (
        F.when((F.col("ending") == "marked") & F.col("any_hit"), "mark")
        .when(F.col("has_longer") & (F.col("ending") != "blank") & (open_ | F.col("at_limit")), "longer copy")
        .when(open_ & F.col("cut_w"), "word").when(open_ & F.col("cut_s"), "sentence").when(open_ & F.col("cut_p") & (~F.col("whole_s") | rarely_whole), "pair").when(open_ & F.col("cut_f"), "first words")
        .when(open_ & F.col("at_limit") & F.col("any_hit"), "limit")
    )
    return told.select("doc_id", "source", "n_chars", reason.alias("reason"))
