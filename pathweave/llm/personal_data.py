"""Personal data: exact base rules and information-theoretic sanitisation, in DataFrame functions.

The protected entities are the matches of the base rules, their owners' groups (the domain of an
email, the network of an ip, the issuer of a card, the leading digits of a phone) and their kinds,
so that entities written once have support. A term is any word of their documents that begins with
a letter. Over all ``n`` documents, with ``n_e`` holding the entity, ``n_t`` the term and ``n_te``
both, the chance of the entity where the term is written is taken as

    p = (n_te + PRIOR * n_e / n) / (n_t + PRIOR)

so that few occurrences prove little, and the term discloses ``1 - log2(p) / log2(n_e / n)`` of the
entity's information: nothing if it says nothing, all if it is never written without the entity. A
term that stands with an entity in at least ``SUPPORT`` different texts and discloses at least
``GENERALISE`` is generalised wherever it is written, and removed from ``REMOVE`` on.

Base kinds, leftmost and not overlapping within a kind: ``email``, ``ip``, ``card``, ``phone``.
Added spans have kind ``term``. The patterns are written with possessive repeats and look-behind,
which match the same and keep long runs of one class linear.

Texts with mentions are joined to their words first, copies of a text once; the words of all
documents are counted only when an entity has enough support.

Defined cases: null texts count as empty and have no spans; without mentions nothing is added;
repeated rows count as often as they come, but as one text for the support; other columns are
left out of the spans and kept by ``sanitised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathweave.session import files_for, materialise

#: Kinds in their order, how they are written, and the words' separators.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x20\x09-\x0D]++"
#: What a text must hold to be searched for a kind at all.
HINTS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda text: text.rlike(r"\+[0-9]"),
}

SUPPORT = 3
#: Documents with the term that are taken to hold the entity as often as all do.
PRIOR = 2
#: Matches or words of a text that are walked through in one go.
STRETCH = 256
#: Flagged terms are first looked for in a table of so many bits, at three places of their hashes.
PLACES = 1 << 18
GENERALISE = 0.8
REMOVE = 0.95

_SPAN = "array<struct<kind:int,start:int,stop:int,found:string>>"


def walked(pieces: Column, kind: str, lengths, spans) -> Column:
    """Spans of pieces one behind the other, as ``kind``; time grows with the pieces.

    ``lengths`` is the length of a piece, ``spans`` the array of its spans if it begins at a place.
    Stretches of pieces are walked through from 0 and then moved, so that no list is copied often.
    """
    none = F.array().cast(kind)
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("firsts"))

    def step(done: Column, x: Column) -> Column:
        return F.struct(
            (done["at"] + lengths(x)).alias("at"), spans(done["spans"], done["at"], x).alias("spans")
        )

    def cut(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int"))
        local = F.transform(
            numbers, lambda k: F.aggregate(F.slice(all_, k * STRETCH + 1, STRETCH), begin, step)
        )
        return F.when(F.size(all_) > 0, _once(local, joined)).otherwise(none)

    def joined(local: Column) -> Column:
        firsts = F.aggregate(
            local,
            empty,
            lambda done, x: F.struct(
                (done["at"] + x["at"]).alias("at"), F.concat(done["firsts"], F.array(done["at"])).alias("firsts")
            ),
            lambda done: done["firsts"],
        )
        return F.flatten(F.zip_with(local, firsts, moved))

    def moved(x: Column, first: Column) -> Column:
        return F.transform(
            x["spans"],
            lambda s: s.withField("start", s["start"] + first).withField("stop", s["stop"] + first),
        )

    return _once(pieces, cut)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches, in code points: between two matches lies one piece of the split."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.arrays_zip(found.alias("found"), gaps.alias("gap"))
    # the last gap has no match behind it
    steps = F.filter(both, lambda x: x["found"].isNotNull())

    def spans(done: Column, at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        span = F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(x["found"])).alias("stop"),
            x["found"].alias("found"),
        )
        return F.concat(done, F.array(span))

    return walked(steps, _SPAN, lambda x: x["gap"] + F.length(x["found"]), spans)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, place: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - place + F.lit(1), F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _valid(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), _byte)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _test(kind: str):
    return lambda s: _valid(kind, s["found"])


def base_spans(text: Column) -> Column:
    """All base spans of a text that is not null, by kind and start."""
    none = F.array().cast(_SPAN)
    each = []
    for number, kind in enumerate(KINDS[:4]):
        spans = F.filter(located(text, PATTERNS[kind], number), _test(kind))
        each.append(F.when(HINTS[kind](text), spans).otherwise(none))
    return F.concat(*each)


def written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])), ","
    )


def found_base(documents: DataFrame) -> DataFrame:
    """``doc_id, text_id, spans, text``: texts' ids and base spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    return base.select("doc_id", F.xxhash64("text").alias("text_id"), base_spans(F.col("text")).alias("spans"), "text")


def _is(kind: int):
    return lambda s: s["kind"] == kind


def _words(text: Column) -> Column:
    """Hashes of the different words of a text that begin with a letter, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w.rlike(r"^\p{L}"))
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def _group(span: Column) -> Column:
    """What entities of one owner share: domain, network, issuer, leading digits."""
    found = F.lower(span["found"])
    digits = _digits(found)
    return (
        F.when(span["kind"] == 0, F.substring_index(found, "@", -1))
        .when(span["kind"] == 1, F.substring_index(found, ".", 3))
        .when(span["kind"] == 2, F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, 1, 5))
    )


def _share(n_te: Column, n_e: Column, n_t: Column, total: int) -> Column:
    """The part of the entity's information that a term discloses; the entity is not everywhere."""
    chance = (n_te + PRIOR * n_e / F.lit(total)) / (n_t + PRIOR)
    # a millionth of tolerance, so that equal counts decide alike everywhere
    return F.floor((1 + F.log2(chance) / F.log2(F.lit(total) / n_e)) * 1e6 + 0.5) / 1e6


def document_terms(found: DataFrame) -> DataFrame:
    """``word, disclosure``: hashes of the terms to generalise or remove, from whole documents."""
    total = found.count()
    entities = F.array_distinct(
        F.concat(
            F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["found"]))),
            F.transform("spans", lambda s: F.xxhash64(F.lit("group"), s["kind"], _group(s))),
            F.transform("spans", lambda s: F.xxhash64(F.lit("kind"), s["kind"])),
        )
    )
    # copies of one text are one row from here on, with their number
    texts = (
        found.filter(F.size("spans") > 0)
        .select("text_id", entities.alias("entities"), _words(F.col("text")).alias("words"))
        .groupBy("text_id")
        .agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    )
    texts = materialise(texts, "texts")
    mentions = texts.select("text_id", "n", F.explode("entities").alias("entity"))
    held = (
        mentions.groupBy("entity")
        .agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"))
        .filter((F.col("texts") >= SUPPORT) & (F.col("n_e") < total))
        .drop("texts")
    )
    held = materialise(held, "entities", files_for(total))
    if held.isEmpty():
        return held.select(F.col("entity").alias("word"), F.lit(0.0).alias("disclosure"))
    beside = texts.select("text_id", F.explode("words").alias("word"))
    enough = beside.groupBy("word").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SUPPORT)
    # every word of the corpus is counted, combined before the shuffle, and only then looked up
    times = found.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_t"))
    terms = materialise(enough.drop("texts").join(times, "word"), "terms")
    n_e, n_t = F.col("n_e"), F.col("n_t")
    # what could not disclose enough even if every mention stood with the term is not paired
    return (
        mentions.join(held, "entity")
        .join(beside.join(terms, "word"), "text_id")
        .filter(_share(F.least(n_e, n_t), n_e, n_t, total) >= GENERALISE)
        .groupBy("entity", "word", "n_e", "n_t")
        .agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") >= SUPPORT)
        .select("word", _share(F.col("n_te"), n_e, n_t, total).alias("disclosure"))
        .filter(F.col("disclosure") >= GENERALISE)
        .groupBy("word")
        .agg(F.max("disclosure").alias("disclosure"))
    )


def _places(word: Column) -> list[Column]:
    return [F.shiftright(word, shift).bitwiseAND(PLACES - 1) for shift in (0, 20, 40)]


def _everywhere(found: DataFrame) -> DataFrame:
    """``row, start, stop, disclosure`` of every occurrence of a flagged term."""
    flagged = materialise(document_terms(found), "flagged", 2)
    bits = [0] * (PLACES // 64)
    for place in flagged.select(F.explode(F.array(*_places(F.col("word")))).alias("p")).distinct().collect():
        bits[place["p"] >> 6] |= 1 << (place["p"] & 63)
    signed = ",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)
    table = F.split(F.lit(signed), ",").cast("array<bigint>")
    kind = "array<struct<word:bigint,start:int,stop:int>>"

    def spans(done: Column, at: Column, piece: Column) -> Column:
        word = F.xxhash64(F.lower(piece))
        one, two, three = (
            F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
            for p in _places(word)
        )
        span = F.struct(word.alias("word"), at.alias("start"), (at + F.length(piece)).alias("stop"))
        return F.when((piece != "") & one & two & three, F.concat(done, F.array(span))).otherwise(done)

    # one separator between two pieces, so ends of the text are borders too
    pieces = F.split("text", r"[\x20\x09-\x0D]", -1)
    seen = walked(pieces, kind, lambda piece: F.length(piece) + 1, spans)
    return (
        found.select("row", F.explode(seen).alias("w"))
        .select("row", "w.*")
        .join(flagged, "word")
        .select("row", "start", "stop", "disclosure")
    )


def find(documents: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``, ``n_terms``, ``all_spans``.

    ``all_spans`` has the terms' disclosure: a row's spans by kind and start.
    """
    base = found_base(documents).withColumn("row", F.monotonically_increasing_id())
    found = materialise(base, "found")
    added = (
        _everywhere(found)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop", "disclosure"))).alias("terms"))
    )
    few = files_for(found.count())
    added = materialise(added, "added", few)
    joined = found.select("row", "doc_id", "spans").join(added, "row", "left").coalesce(few)
    base = F.transform(
        "spans",
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
            F.lit(None).cast("double").alias("disclosure"),
        ),
    )
    # a term that touches a base span is covered by it
    free = F.filter(
        F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,disclosure:double>>")),
        lambda t: ~F.exists("spans", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])),
    )
    term = F.transform(
        free,
        lambda t: F.struct(
            F.lit(4).alias("kind"), t["start"].alias("start"), t["stop"].alias("stop"),
            t["disclosure"].alias("disclosure"),
        ),
    )
    counts = [
        F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS[:4])
    ]
    return joined.select(
        "doc_id",
        *counts,
        F.sha2(written(F.col("spans")), 256).alias("base_sha256"),
        F.concat(base, term).alias("all_spans"),
    ).select(
        "doc_id", *[f"n_{kind}" for kind in KINDS[:4]], "base_sha256",
        written(F.col("all_spans")).alias("spans"),
        F.size(F.filter("all_spans", lambda s: s["kind"] == 4)).cast("long").alias("n_terms"),
        "all_spans",
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with base spans and generalised terms named, and removed terms gone."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), s["stop"].alias("stop"),
                F.when(s["disclosure"] >= REMOVE, "").otherwise(F.get(names, s["kind"])).alias("mask"),
            ),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(text, done["at"] + 1, F.greatest(F.lit(0), s["start"] - done["at"]))
        mask = F.when(s["start"] >= done["at"], s["mask"]).otherwise("")
        return F.struct(
            F.greatest(done["at"], s["stop"]).alias("at"), F.concat(done["out"], gap, mask).alias("out")
        )

    return F.aggregate(
        ordered, start, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
    )
