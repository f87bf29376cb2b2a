"""Personal data: base patterns, and information-theoretic sanitisation of terms that give it away.

Base: e-mail addresses, IPv4 addresses, payment cards and phone numbers, found by pattern and checked.

Disclosure: an entity is a distinct base value. From co-occurrence over the whole corpus, a term t tells of an
entity e the part PMI(t; e) / IC(e) = log(c N / (df(t) df(e))) / log(N / df(e)) of what e itself does, where N is
the number of documents, df counts documents and c those with both. What a term tells at most decides: from
`generalise` on it is replaced by a general word, from `remove` on it is taken out, wherever it stands, in
documents without base values too.

Only DataFrame functions. Entities of the same documents tell the same of each term, so they are one class, and
pairs of classes and terms are counted once for all copies of a text, and only for terms that are rare enough to
reach `generalise` with the class. Of documents without base values only counts of terms travel, and the places
of terms that tell. Texts meet their marks by a hash of the text; two texts that shared one would be given each
other's marks, of which only places with telling terms are used, so the hash has 128 bits.

Defined cases: a null text counts as empty; a null id is kept; repeated rows count as documents of their
own; an entity in all documents has no information and discloses nothing; base spans may overlap, and a term
is read from the text that is left between them; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import ascii_lower
from lodestat.sources.shared import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds.
ADDED = ("generalise", "remove")
SUPPORT, GENERALISE, REMOVE = 1, 0.8, 0.95
#: A term: a longest run of letters and digits, A-Z lower-cased.
TERM = r"[\p{L}\p{N}]+"
#: A term with all since the one before; it begins where the last one ended, so that what no term follows is tried once.
PIECE = r"\G[^\p{L}\p{N}]*+[\p{L}\p{N}]++"
#: Code points of the blocks that texts are cut into, so that a place in a long text is reached at once.
BLOCK = 1024
#: Tables of terms up to this many rows are broadcast (some 100 bytes each), and tables of marks up to so many spans.
BROADCAST_TERMS, BROADCAST_SPANS = 200_000, 200_000

# A match can only begin where a run begins, or where the match before ended: without that, long runs that
# never match would be tried from each of their characters. Possessive repeats keep matching iterative.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text with any valid match must have; cheap to look for.
_HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}

_SPAN = "struct<kind:string,begin:int,stop:int,value:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often, and in whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _folded(items: Column, add: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """A fold from left to right that carries a number and may give a value for each item; the values, less nulls.

    Arrays are grown in chunks of about the square root of the items, since each append copies what it is added to.
    """

    def over(items: Column, chunk: Column) -> Column:
        def of_chunk(state: Column, number: Column) -> Column:
            def of_item(s: Column, item: Column) -> Column:
                return _let(F.struct(*(c.alias(n) for c, n in zip(add(s["at"], item), ("at", "value"), strict=True))), lambda new: F.struct(
                    new["at"].cast("int").alias("at"),
                    F.when(new["value"].isNull(), s["part"]).otherwise(F.concat(s["part"], F.array(new["value"]))).alias("part"),
                ))

            start = F.struct(state["at"].alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("part"))
            finish = lambda s: F.struct(s["at"].alias("at"), F.concat(state["done"], F.array(s["part"])).alias("done"))
            return F.aggregate(F.slice(items, number * chunk + 1, chunk), start, of_item, finish)

        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("done"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / chunk).cast("int")), start, of_chunk, lambda s: s["done"]))

    def sized(items: Column) -> Column:
        some = _let(F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int")), lambda chunk: over(items, chunk))
        return F.when(F.size(items) > 0, some).otherwise(F.expr(f"cast(array() as array<{kind}>)"))

    return _let(items, sized)


def _located(text: Column, pattern: Column, kind: str) -> Column:
    """All matches with their places, in code points: a match begins after the pieces and matches before it."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))

    def add(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + F.length(pair["gap"])
        stop = begin + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), stop.alias("stop"), pair["match"].alias("value"))
        # the last gap has no match after it
        return F.coalesce(stop, at), F.when(pair["match"].isNotNull(), span)

    return _folded(pairs, add, _SPAN)


def _word_ends(text: Column, words: Column) -> Column:
    """Where each of some words of a text ends, by their numbers in order of the text.

    A piece is a word and all since the word before. Lengths of pieces are summed in chunks of about the square
    root of the words, so that a word's place needs the sum of the chunks before and of a part of its own.
    """
    lengths = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.length)
    added = lambda sizes: F.aggregate(sizes, F.lit(0), lambda n, x: n + x)

    def ends(sizes: Column, chunk: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int"))
        sums = F.aggregate(numbers, F.array(F.lit(0)), lambda done, c: F.concat(done, F.array(F.element_at(done, -1) + added(F.slice(sizes, c * chunk + 1, chunk)))))

        def end(starts: Column, word: Column) -> Column:
            of = F.floor(word / chunk).cast("int")
            return F.get(starts, of) + added(F.slice(sizes, of * chunk + 1, word % chunk + 1))

        return _let(sums, lambda starts: F.transform(words, lambda word: end(starts, word)))

    return _let(lengths, lambda sizes: _let(F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(sizes))).cast("int")), lambda chunk: ends(sizes, chunk)))


def _rewritten(text: Column, spans: Column, word: Callable[[Column], Column]) -> Column:
    """The text with `word` in place of each span; what spans share is left to the one that begins first, then to the longer."""

    def clip(at: Column, span: Column) -> tuple[Column, Column]:
        rest = F.struct(span["kind"].alias("kind"), F.greatest(at, span["begin"]).alias("begin"), span["stop"].alias("stop"), span["value"].alias("value"))
        return F.greatest(at, span["stop"]), F.when(span["stop"] > at, rest)

    def cut(blocks: Column, begin: Column, stop: Column) -> Column:
        first, last = F.floor(begin / BLOCK).cast("int"), F.floor((stop - 1) / BLOCK).cast("int")
        one = F.substring(F.get(blocks, first), begin % BLOCK + 1, stop - begin)
        head, tail = F.substring(F.get(blocks, first), begin % BLOCK + 1, F.lit(BLOCK)), F.substring(F.get(blocks, last), F.lit(1), (stop - 1) % BLOCK + 1)
        more = F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail)
        return F.when(stop <= begin, "").when(first == last, one).otherwise(more)

    def put_together(apart: Column, blocks: Column) -> Column:
        ends = F.transform(apart, lambda x: x["stop"])
        # each gap begins where the span before it ended
        gaps = F.zip_with(apart, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), lambda x, begin: F.concat(cut(blocks, begin, x["begin"]), word(x)))
        return F.concat(F.array_join(gaps, ""), cut(blocks, F.element_at(apart, -1)["stop"], F.length(text)))

    # by begin, then the longer one, then as listed
    ordered = F.transform(F.array_sort(F.transform(spans, lambda x, i: F.struct(x["begin"].alias("b"), (-x["stop"]).alias("s"), i.alias("i"), x.alias("x")))), lambda o: o["x"])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    changed = _let(_folded(ordered, clip, _SPAN), lambda apart: _let(blocks, lambda cut_up: put_together(apart, cut_up)))
    return F.when(F.size(spans) > 0, changed).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of spans; all places stay as they were."""
    return _rewritten(text, spans, lambda x: F.repeat(F.lit(" "), x["stop"] - x["begin"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (F.substring(short, 1, 3) <= "255"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _octet)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid base matches of a text: kind by kind, each from left to right; array of (kind, begin, stop, value)."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def of(kind: str) -> Column:
        found = F.filter(_located(text, F.lit(PATTERNS[kind]), kind), lambda s: _valid(kind, s["value"]))
        return F.when(text.rlike(_HINTS[kind]), found).otherwise(none)

    return F.concat(*(of(k) for k in KINDS))


def _entity(span: Column) -> Column:
    """A base value as an entity: e-mail addresses without case, numbers by their digits."""
    value = F.when(span["kind"] == "email", ascii_lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


_TEXT_KEY = ["__h", "__g"]


def _keyed(text: Column) -> list[Column]:
    """A hash of 128 bits that stands for a text."""
    return [F.xxhash64(text).alias("__h"), F.xxhash64(F.lit("again"), text).alias("__g")]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """With a broadcast hint where the table is proven to have at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def disclosures(private: DataFrame, sizes: DataFrame, documents: int, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term, told): terms that tell at least the part `generalise` of some entity, and how much of one at most.

    private: distinct texts with base values (their key, copies, entities, terms); sizes: (term, m) over all documents.
    """
    held = private.select(*_TEXT_KEY, "copies", F.explode("entities").alias("entity"))
    # Entities that the same texts have are one class: sums of hashes stand for the set of texts.
    sums = [F.sum("copies").alias("n"), F.count("*").alias("k"), F.bit_xor("__h").alias("x"), F.bit_xor("__g").alias("y")]
    classes = held.groupBy("entity").agg(*sums).where((F.col("n") >= support) & (F.col("n") < documents))
    held = cut_lineage(held.join(cut_lineage(classes), "entity").select(*_TEXT_KEY, "n", F.struct("n", "k", "x", "y").alias("class")).distinct())
    most = held.agg(F.max("n").alias("n")).first().n
    if most is None:
        return sizes.limit(0).select("term", F.lit(0.0).alias("told"))
    total = F.lit(float(documents))
    # As c is at most df(t), a term with more documents than this can't tell enough of an entity of n (a little more, for rounding).
    bound = lambda n: F.pow(n.cast("double"), F.lit(generalise)) * F.pow(total, F.lit(1 - generalise)) * 1.000001
    rare = sizes.where((F.col("m") >= support) & (F.col("m") <= bound(F.lit(most))))
    terms = private.select(*_TEXT_KEY, "copies", F.explode("terms").alias("term")).join(rare, "term")
    met = terms.join(held, _TEXT_KEY).where(F.col("m") <= bound(F.col("n")))
    together = met.groupBy("class", "term", "n", "m").agg(F.sum("copies").alias("c")).where(F.col("c") >= support)
    # A base value may end within a word, whose rest is a term of fewer whole texts than there are with both.
    told = F.log(F.least("c", "m") * total / (F.col("m") * F.col("n"))) / F.log(total / F.col("n"))
    return together.groupBy("term").agg(F.max(told).alias("told")).where(F.col("told") >= generalise)


def _hits(rows: DataFrame, telling: DataFrame, sizes: DataFrame) -> DataFrame:
    """(text key, hits): of each distinct text with telling terms, the numbers of those words, their lengths and whether they are removed."""
    words = rows.select(*_TEXT_KEY, F.posexplode(_words(_blanked(F.col("__text"), F.col("spans")))).alias("i", "term"))
    few = _bounded(telling, BROADCAST_TERMS)
    if few is telling:
        # Too many to be sent: the words of most places, few and frequent ones that don't tell, are left out before the shuffle.
        frequent = sizes.orderBy(F.desc("m"), "term").limit(BROADCAST_TERMS).select("term").join(telling, "term", "left_anti")
        words = words.join(F.broadcast(cut_lineage(frequent)), "term", "left_anti")  # at most BROADCAST_TERMS rows
    found = words.join(few, "term").select(*_TEXT_KEY, "i", F.length("term").alias("n"), "remove").distinct()
    return found.groupBy(*_TEXT_KEY).agg(F.array_sort(F.collect_list(F.struct("i", "n", "remove"))).alias("hits"))


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id_col, spans (kind, begin, stop, and the value of base kinds; then those of the kinds `generalise` and `remove`) and sanitised (the text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), *_keyed(text))
    documents = docs.select(F.lit(1)).count()
    marked = rows.select(*_TEXT_KEY, "__text", base_spans(F.col("__text")).alias("spans"))
    own = F.array_distinct(_words(_blanked(F.col("__text"), F.col("spans"))))
    entities = F.array_distinct(F.transform("spans", _entity))
    private = cut_lineage(marked.where(F.size("spans") > 0).select(*_TEXT_KEY, "spans", entities.alias("entities"), own.alias("terms")))
    copies = private.groupBy(*_TEXT_KEY).agg(F.count("*").alias("copies"))
    private = cut_lineage(private.dropDuplicates(_TEXT_KEY).join(cut_lineage(copies), _TEXT_KEY))
    sizes = cut_lineage(rows.select(F.explode(F.array_distinct(_words(F.col("__text")))).alias("term")).groupBy("term").agg(F.count("*").alias("m")))
    told = cut_lineage(disclosures(private, sizes, documents, support, generalise))
    telling = cut_lineage(told.select("term", (F.col("told") >= remove).alias("remove")))
    marks = cut_lineage(private.select(*_TEXT_KEY, "spans").join(_hits(marked, telling, sizes), _TEXT_KEY, "full_outer"))
    spans_of = marks.agg(F.sum(F.coalesce(F.array_size("spans"), F.lit(0)) + F.coalesce(F.array_size("hits"), F.lit(0)) + 1).alias("n")).first().n
    # Up to so many spans travel to the texts; with more, the texts are shuffled to their spans.
    out = rows.join(F.broadcast(marks) if (spans_of or 0) <= BROADCAST_SPANS else marks.hint("merge"), _TEXT_KEY, "left")
    out = out.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as array<{_SPAN}>)")))
    ends = _word_ends(_blanked(F.col("__text"), F.col("spans")), F.transform("hits", lambda h: h["i"]))

    def span(hit: Column, stop: Column) -> Column:
        kind = F.when(hit["remove"], "remove").otherwise("generalise")
        return F.struct(kind.alias("kind"), (stop - hit["n"]).alias("begin"), stop.alias("stop"), kind.alias("value"))

    out = out.withColumn("added", F.when(F.col("hits").isNotNull(), F.zip_with("hits", ends, span)))
    of_kinds = [F.filter("added", lambda x: x["kind"] == ADDED[0]), F.filter("added", lambda x: x["kind"] == ADDED[1])]
    out = out.withColumn("spans", F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.concat("spans", *of_kinds)))
    word = lambda x: F.when(x["kind"] == "remove", "").when(x["kind"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    return out.select(F.col("__id").alias(id_col), "spans", _rewritten(F.col("__text"), F.col("spans"), word).alias("sanitised"))
