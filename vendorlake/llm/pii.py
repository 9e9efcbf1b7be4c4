"""PII by information-theoretic sanitisation, in DataFrame functions alone.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by pattern. Each value found is a protected
entity e. A term t (a whole word of a document that holds e, outside all values found) reveals e to the degree that knowing t takes away e's
information content, estimated from the corpus:

    disclosure(e, t) = PMI(e; t) / IC(e) = log(n(e, t) * N / (n(e) * n(t))) / log(N / n(e))

with N documents, n(e) of them holding e, n(t) holding t, and n(e, t) holding both. Terms that share documents with e in
at least SUPPORT different contexts (the REACH characters on either side of e, as far as the next value of its kind), and
disclose it to GENERALISE or more, are generalised; at REMOVE or more, removed: at every place, in all documents. All
counts are over all documents, a repeated row counting as often as it stands.

Places come from running sums over the lengths of matches and of what lies between them. As an array that grows by one
element a step is copied each time, sums are taken in runs of RUN elements, and texts are cut from blocks of BLOCK
characters, so that the time grows about as the text does, however many values it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written

REACH, SUPPORT, GENERALISE, REMOVE = 60, 3, 0.8, 0.95
RUN, BLOCK = 256, 4096
#: Stands for each character of a value found, as a part of any word that touches it.
_GAP = "\uffff"
#: Revealing terms, and the documents that hold some, of up to so many rows go to every executor; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns' leftmost matches; possessive and anchored at the start of a run or at the last match, so that they take time in proportion to the text.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[ -][0-9]++)*+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: What lies between words; texts are split there, which takes about a quarter of the time that extracting words takes.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_HIT = "array<struct<kind:int,start:int,stop:int,value:string,context:bigint>>"
_TERM = "array<struct<start:int,stop:int,disclosure:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    back = F.reverse(_digits(m))
    def add(total: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    n = F.length(_digits(m))
    return (
        F.lit(True), m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), F.when(n.between(13, 19), _luhn(m)).otherwise(False), n.between(9, 15)
    )[kind]


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once. A column named in a lambda may be put in place there by the optimiser and computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scanned(xs: Column, step, kind: str, wanted=None) -> Column:
    """For each element x of the array xs in order y, where step(at, x) gives the next `at` and y; at begins with 0. Only of those x for which wanted(x) holds, if given."""
    none = F.array().cast(kind)

    def mark(s: Column, x: Column) -> Column:
        marks = F.when(s["i"] % RUN == 0, F.concat(s["marks"], F.array(s["at"]))).otherwise(s["marks"])
        return F.struct(step(s["at"], x)[0].alias("at"), (s["i"] + 1).alias("i"), marks.alias("marks"))

    def add(s: Column, x: Column) -> Column:
        at, y = step(s["at"], x)
        more = F.concat(s["out"], F.array(y))
        return F.struct(at.alias("at"), (more if wanted is None else F.when(wanted(x), more).otherwise(s["out"])).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("marks"))

    def runs(v: Column) -> Column:
        one = lambda at, c: F.aggregate(F.slice(v["xs"], c * RUN + 1, F.lit(RUN)), F.struct(at.alias("at"), none.alias("out")), add, lambda s: s["out"])
        return F.flatten(F.transform(F.aggregate(v["xs"], begin, mark, lambda s: s["marks"]), one))

    return F.coalesce(_let(F.struct(xs.alias("xs")), runs), none)


def _matched(text: str, pattern: str, may: Column) -> Column:
    """Of each match of the pattern g (how many characters lie before it since the last one), m and its context; none unless `may` holds."""

    def one(v: Column, i: Column) -> Column:
        before, after = F.get(v["gaps"], i), F.get(v["gaps"], i + 1)
        context = F.xxhash64(F.right(before, F.lit(REACH)), F.left(after, F.lit(REACH)))
        return F.struct(F.length(before).alias("g"), F.get(v["found"], i).alias("m"), context.alias("context"))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    each = _let(found, lambda v: F.transform(v["found"], lambda _, i: one(v, i)))
    return F.when(may, each).otherwise(F.array().cast("array<struct<g:int,m:string,context:bigint>>"))


def with_hits(df: DataFrame, text: str = "text") -> DataFrame:
    """df with column hits: the base's spans of its text, by kind as listed and then by start, with each value and a hash of its surroundings; in code points, the end exclusive."""
    t = F.col(text)
    kinds = (
        (_EMAIL, F.contains(t, F.lit("@"))),
        (_IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        (_CARD, t.rlike(r"(?:[0-9][ -]?){13}")),
        (_PHONE, F.contains(t, F.lit("+"))),
    )
    for k, (pattern, may) in enumerate(kinds):

        def hit(at: Column, x: Column, k=k) -> tuple[Column, Column]:
            start = at + x["g"]
            stop = start + F.length(x["m"])
            return stop, F.struct(F.lit(k).alias("kind"), start.alias("start"), stop.alias("stop"), F.lower(x["m"]).alias("value"), x["context"].alias("context"))

        df = df.withColumn(f"hits_{k}", _scanned(_matched(text, pattern, may), hit, _HIT))
    valid = lambda k: F.filter(f"hits_{k}", lambda h: _valid(k, h["value"]))
    return df.withColumn("hits", F.concat(*(valid(k) for k in range(4)))).drop(*(f"hits_{k}" for k in range(4)))


def _words(text: Column) -> Column:
    """The distinct words of a text, lowered."""
    # Texts are lowered as a whole, which is faster; what a capital sigma becomes hangs on the letters around it, so there it is done word by word.
    by_word = F.array_distinct(F.transform(F.split(text, _BETWEEN, -1), F.lower))
    return F.when(F.contains(text, F.lit("\u03a3")), by_word).otherwise(F.array_distinct(F.split(F.lower(text), _BETWEEN, -1)))


def _is_term(word: Column) -> Column:
    """A word of digits only is no term, nor is one that touches a value found."""
    return (F.translate(word, "0123456789", "") != "") & ~F.contains(word, F.lit(_GAP))


def _replaced(df: DataFrame, out: str, spans: Column, tag, text: str = "text") -> DataFrame:
    """df with column out: the text with tag(at, span) for each span (start, stop, ...), where what lies before `at` is written already."""

    def piece(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["stop"]), F.struct(at.alias("a"), F.greatest(at, x["start"]).alias("b"), x["stop"].alias("stop"), tag(at, x).alias("tag"))

    def whole(v: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
            return F.when(b <= a, "").otherwise(F.substring(F.array_join(F.slice(v["blocks"], i + 1, j - i + 1), ""), a - i * BLOCK + 1, b - a))

        parts = F.transform(v["pieces"], lambda p: F.concat(cut(p["a"], p["b"]), p["tag"]))
        end = F.aggregate(v["pieces"], F.lit(0), lambda at, p: F.greatest(at, p["stop"]))
        return F.array_join(F.concat(parts, F.array(cut(end, F.length(text)))), "")

    pieces = _scanned(F.array_sort(spans), piece, "array<struct<a:int,b:int,stop:int,tag:string>>")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    replaced = _let(F.struct(pieces.alias("pieces"), blocks.alias("blocks")), whole)
    return df.withColumn(out, F.when(F.size(spans) > 0, replaced).otherwise(F.col(text)))


def with_masked(df: DataFrame) -> DataFrame:
    """df with column masked: the text with each character of its hits as _GAP, so that all places stay."""
    spans = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop")))
    return _replaced(df, "masked", spans, lambda at, x: F.repeat(F.lit(_GAP), F.greatest(x["stop"] - F.greatest(at, x["start"]), F.lit(0))))


def _disclosure(total: int, n_t: str) -> Column:
    pmi = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.greatest(n_t, "n_et")))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    return F.when(ic > 0, pmi / ic).otherwise(0.0)


def _revealing(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, terms): of the documents that have any, the spans of revealing terms with their disclosure. docs: key, text; hits: key, hits; a row each."""
    holders = hits.where(F.size("hits") > 0).groupBy("key").agg(F.count("*").alias("rows"), F.first("hits").alias("hits"))
    holders = written(holders, "holders")
    one = holders.select("key", "rows", F.explode("hits").alias("h")).select("key", "rows", F.concat_ws(":", "h.kind", "h.value").alias("e"), "h.context").distinct()
    by_document = one.groupBy("e", "key").agg(F.first("rows").alias("rows")).groupBy("e").agg(F.sum("rows").alias("n_e"))
    # A pair has no more contexts than its entity: most entities are settled by that.
    entities = one.groupBy("e").agg(F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= SUPPORT).join(by_document, "e")
    one = written(one.join(entities.drop("contexts"), "e"), "entities")
    total = docs.count()
    wanted = one.select("key").distinct().join(holders, "key")
    wanted = F.broadcast(wanted) if one.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    held = with_masked(docs.join(wanted, "key")).select("key", "rows", F.explode_outer(_words(F.col("masked"))).alias("t")).where(_is_term(F.col("t"))).distinct()
    held = written(held, "held")
    # Bounds that settle a term before it meets entities: it has at most as many contexts as its documents' entities have, and
    # is held by n_beside documents at least, so that the pair's disclosure is at most log(total / n_beside) / log(total / n_e).
    each = one.groupBy("key", "e").agg(F.count("*").alias("c"), F.min("context").alias("least"))
    most = each.groupBy("key").agg(F.max("c").alias("most"))
    n_beside = held.join(most, "key").groupBy("t").agg(F.sum("rows").alias("n_beside"), F.sum("most").alias("most")).where(F.col("most") >= SUPPORT).drop("most")
    reached = F.log(F.lit(float(total)) / F.col("n_beside")) >= GENERALISE * F.log(F.lit(float(total)) / F.col("n_e")) - 1e-9
    pairs = one.join(each.drop("c"), ["key", "e"]).select("key", "e", "context", "n_e", (F.col("context") == F.col("least")).alias("own"))
    pairs = pairs.join(held.join(n_beside, "t"), "key").where(reached)
    # Each document's rows count at one of its contexts of the entity.
    same = [F.first(c).alias(c) for c in ("n_e", "n_beside")]
    pairs = pairs.groupBy("e", "t", "context").agg(F.sum(F.when(F.col("own"), F.col("rows")).otherwise(0)).alias("n_et"), *same)
    pairs = pairs.groupBy("e", "t").agg(F.count("*").alias("contexts"), F.sum("n_et").alias("n_et"), *same)
    pairs = written(pairs.where((F.col("contexts") >= SUPPORT) & (_disclosure(total, "n_beside") >= GENERALISE)).select("e", "t", "n_et", "n_e"), "candidates")
    discard(one, held)
    masked = _all_masked(docs, holders)
    wanted = pairs.select("t").distinct()
    wanted = F.broadcast(wanted) if pairs.count() <= BROADCAST_ROWS else wanted
    # The places of all candidates, by one pass over the texts: a row for each row of docs and candidate in it.
    met = written(masked.select("key", F.explode_outer(_words(F.col("masked"))).alias("t")).join(wanted, "t"), "met")
    n_t = met.groupBy("t").agg(F.count("*").alias("n_t"))
    known = pairs.join(n_t, "t").withColumn("disclosure", _disclosure(total, "n_t")).where(F.col("disclosure") >= GENERALISE)
    revealing = written(known.groupBy("t").agg(F.max("disclosure").alias("disclosure")), "revealing")
    revealing = F.broadcast(revealing) if revealing.count() <= BROADCAST_ROWS else revealing
    holding = met.join(revealing, "t").groupBy("key", "t").agg(F.first("disclosure").alias("disclosure"))
    holding = holding.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("t", "disclosure"))).alias("held"))
    holding = written(holding, "holding")
    discard(pairs, met)
    few = F.broadcast(holding) if holding.count() <= BROADCAST_ROWS else holding.hint("shuffle_hash")

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["g"]
        return start + x["n"], F.struct(start.alias("start"), (start + x["n"]).alias("stop"), x["d"].alias("disclosure"))

    # Words and what lies between them alternate: word i follows gap i.
    words = F.filter(F.split("masked", _BETWEEN, -1), lambda w: w != "")
    with_gaps = F.zip_with(
        F.split("masked", _WORD, -1), words, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("n"), F.try_element_at("held", F.lower(m)).alias("d"))
    )
    places = _scanned(with_gaps, place, _TERM, lambda x: x["d"].isNotNull())
    return masked.join(few, "key").select("key", places.alias("terms")).groupBy("key").agg(F.first("terms").alias("terms"))


def _all_masked(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """key, text and masked of every row: masked is the text where the document holds no value."""
    few = F.broadcast(holders) if holders.count() <= BROADCAST_ROWS else holders
    none = F.array().cast(_HIT)
    return with_masked(docs.join(few.select("key", "hits"), "key", "left").withColumn("hits", F.coalesce("hits", none))).select("key", "text", "masked")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """One row per row of docs: id_col, the columns of keep, hits (array: the base's spans, by kind as listed and then by
    start), terms (array: revealing terms' start, stop, disclosure), and if texts is set sanitised (string: base spans
    replaced by [KIND], terms by [TERM] or, at REMOVE, by nothing).

    Spans are in code points, the end exclusive. A null text counts as empty and is sanitised to an empty text. A null id
    is kept; repeated rows come out as often as they came in. Columns of docs other than those named are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(*(F.col(c).alias(f"kept_{c}") for c in keep), F.col(id_col).alias("id"), text.alias("text"))
    d = d.withColumn("key", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"))
    hits = written(with_hits(d).select("id", "key", *(["text", *(f"kept_{c}" for c in keep)] if texts else []), "hits"), "hits")
    terms = written(_revealing(d.select("key", "text"), hits.select("key", "hits")), "terms")
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    d = hits.join(terms, "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast(_TERM)))
    if texts:
        tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
        spans = F.concat(
            F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop"), F.element_at(tags, h["kind"] + 1).alias("tag"))),
            F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.when(t["disclosure"] >= REMOVE, "").otherwise("[TERM]").alias("tag"))),
        )
        # Of overlapping spans the first counts.
        d = _replaced(d, "sanitised", spans, lambda at, x: F.when(x["start"] >= at, x["tag"]).otherwise(""))
    return d.select(F.col("id").alias(id_col), *(F.col(f"kept_{c}").alias(c) for c in keep if texts), "hits", "terms", *(["sanitised"] if texts else []))


def span_names(hits: Column, terms: Column | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    names = F.transform(hits, lambda h: F.concat_ws(":", F.element_at(kinds, h["kind"] + 1), h["start"], h["stop"]))
    if terms is not None:
        names = F.concat(names, F.transform(terms, lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["stop"])))
    return F.array_join(names, ",")
