"""Personal data: base patterns, and terms that disclose the entities they stand for. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Then, after information-theoretic
sanitisation, terms are judged by what they tell about a protected entity: a base value, or what values share (a
mailbox name, a domain, a network, the first digits of numbers). Over the distinct texts of the corpus, the smoothed
pointwise mutual information of term and entity, near each other, is compared with the information content of the
entity. A term discloses an entity if it tells enough of it, if the entity is nearly always near where the term is
named, and if chance would hardly bring the two together so often. Such terms are spans in every text that names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh

#: The patterns find what `[A-Za-z0-9._%+-]+@...`, `[0-9]+(\.[0-9]+)...`, `[0-9]([ -]?[0-9])+` and `\+[0-9]...[0-9]` find,
#: but start only where a run starts (or the last match ended) and never give characters back where that can't help.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: Shares that a disclosing term must reach: of the entity's information content that it tells, and of its own texts that hold the entity near it.
DISCLOSURE, CERTAINTY = 0.8, 0.6
#: Unlike texts that must show a term near an entity, and the number of pairs expected to pass by chance alone.
SUPPORT, CHANCE = 2, 0.01
#: Words between which a term is near an entity: windows of twice so many words, each beginning so many after the last.
NEAR = 32
#: Terms up to so many bytes together are broadcast; more are joined.
BROADCAST_BYTES = 16 << 20

#: A term: a run of letters and digits, of any length; parts of addresses are terms too, such as the name before the @.
_WORD, _SPACE = r"[\p{L}\p{N}]+", r"[\x20\x09-\x0D]+"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Matches that are summed up together.
_RUN = 128


def _name(column: str) -> str:
    return f"`{column}`"


def _bound(value: str, name: str, use: str) -> str:
    """SQL of `use` with value computed once under a name, however often it is used."""
    return f"transform(array({value}), {name} -> {use})[0]"


def running(numbers: str, op: str = "{} + {}") -> str:
    """SQL of the running sums (or what op, with 0 as its neutral number, makes) of an array of ints, not empty.

    It is made in runs, as adding to a long array copies it each time.
    """

    def over(xs: str, base: str) -> str:
        step = op.format("s.at", "b")
        return f"aggregate({xs}, named_struct('at', {base}, 'out', cast(array() as array<int>)), (s, b) -> named_struct('at', {step}, 'out', concat(s.out, array({step}))), s -> s.out)"

    starts, run = f"sequence(0, (size(xs) - 1) div {_RUN})", f"slice(xs, cast(i * {_RUN} as int) + 1, {_RUN})"
    totals = f"transform({starts}, i -> aggregate({run}, 0, (a, b) -> {op.format('a', 'b')}))"
    return _bound(numbers, "xs", _bound(over(totals, "0"), "ends", f"flatten(transform({starts}, i -> {over(run, 'if(i = 0, 0, get(ends, cast(i as int) - 1))')}))"))


def located(text: str, pattern: str, kind: str) -> str:
    """SQL of array<struct<kind, start, end, value>>: the pattern's matches in a text in code points, end exclusive, in time linear in it."""
    # a match ends where the gaps and matches up to it end
    steps = f"zip_with(hits, slice(split({text}, r'{pattern}', -1), 1, size(hits)), (h, g) -> length(h) + length(g))"
    spans = f"zip_with(hits, {running(steps)}, (h, e) -> named_struct('kind', '{kind}', 'start', e - length(h), 'end', e, 'value', h))"
    return _bound(f"regexp_extract_all({text}, r'{pattern}', 0)", "hits", f"if(size(hits) = 0, cast(array() as {_SPAN}), {spans})")


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
#: True if a string of digits has a valid check digit.
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> cast(d as int) * if(i % 2 = 0, 1, 2) - if(i % 2 = 1 and d > '4', 9, 0)), 0, (n, d) -> n + coalesce(d, 0)) % 10 = 0"
_BARE = "ltrim('0', p)"
_KEEP = {
    "email": "true",
    "ip": f"forall(split(s.value, r'\\.'), p -> if(length({_BARE}) <= 3, cast(concat('0', {_BARE}) as int) <= 255, false))",
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def base_spans(text_col: str) -> Column:
    """All base spans of a text (null: none), by kind in the order of KINDS, then start; matches that fail their check are dropped."""
    return F.expr(_base(_name(text_col)))


def _base(text: str) -> str:
    none = f"cast(array() as {_SPAN})"
    found = (f"if({f"contains({text}, '{mark}')" if mark else 'true'}, filter({located(text, pattern, kind)}, s -> {_KEEP[kind]}), {none})" for kind, (pattern, mark) in KINDS.items())
    return f"if({text} is null, {none}, concat({', '.join(found)}))"


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: str) -> str:
    return f"array_distinct(regexp_extract_all(lower({text}), r'{_WORD}', 0))"


def words(text_col: str) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.expr(_words(_name(text_col)))


def windows(text_col: str) -> Column:
    """The overlapping windows of 2 * NEAR stretches without white space of a text, lower-cased, that may hold an entity: any NEAR + 1 neighbours are together in one."""
    starts = f"sequence(0, greatest(0, cast(ceil(size(ws) / {NEAR}) as int) - 2))"
    cut = _bound(f"filter(split(lower({_name(text_col)}), r'{_SPACE}'), w -> w <> '')", "ws", f"transform({starts}, i -> array_join(slice(ws, i * {NEAR} + 1, {2 * NEAR}), ' '))")
    return F.expr(f"filter({cut}, win -> win rlike '[0-9@]')")


def entities(text_col: str) -> Column:
    """The distinct entities of a text: numbers by their digits, addresses, and what values share, which begins or ends with @ or ends with a dot."""
    shared = f"""case s.kind when 'email' then array(s.value, concat(substring_index(s.value, '@', 1), '@'), concat('@', substring_index(s.value, '@', -1)))
        when 'ip' then array(s.value, concat(substring_index(s.value, '.', 3), '.'))
        when 'phone' then array(concat('+', {_DIGITS}), concat('+', left({_DIGITS}, length({_DIGITS}) - 4), '.'))
        else array({_DIGITS}) end"""
    return F.expr(f"array_distinct(flatten(transform({_base(_name(text_col))}, s -> {shared})))")


def sketch(text_col: str) -> Column:
    """The two smallest word hashes of a window as one number: near copies of a window mostly share it, unlike windows hardly ever."""
    return F.expr(f"xxhash64(slice(array_sort(array_distinct(transform(filter(split({_name(text_col)}, ' '), w -> not w rlike '[0-9@]'), w -> xxhash64(w)))), 1, 2))")


def _small(terms: DataFrame, size: Column) -> DataFrame:
    """terms, to be broadcast if they have at most BROADCAST_BYTES by size."""
    return F.broadcast(terms) if (terms.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES else terms


def near_entities(holding: DataFrame) -> DataFrame:
    """Of the distinct texts with entities, holding (line): (entity, term, n_e, n_te, trials) where the term may disclose the entity.

    n_e counts the texts that hold the entity in a window, n_te the unlike ones that have the term near it: texts that
    show the pair in windows of one sketch count once, so that near copies are no support. trials are all pairs in all windows.
    """
    texts = holding.select(text_key("line").alias("text_key"), F.explode(windows("line")).alias("win"))
    shown = durable(texts.withColumn("entities", entities("win")).where(F.size("entities") > 0).select("text_key", sketch("win").alias("sketch"), "entities", words("win").alias("terms")))
    n_e = durable(shown.select("text_key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT))
    least = durable(holding.select(F.explode(words("line")).alias("term")).groupBy("term").agg(F.count("*").alias("least")).where(F.col("least") >= SUPPORT))
    near = shown.select("text_key", "sketch", "terms", F.explode("entities").alias("entity")).join(_small(n_e, F.octet_length("entity")), "entity")
    own = F.col("term").contains(F.col("entity")) | (F.col("entity").rlike("^@|[@.]$") & F.col("entity").contains(F.col("term")))
    near = near.select("text_key", "sketch", "entity", "n_e", F.explode("terms").alias("term")).where(~own).join(_small(least, F.octet_length("term")), "term")
    near = near.where(F.col("n_e") >= CERTAINTY * (F.col("least") + 1))
    near = near.groupBy("entity", "term", "n_e", "least", "text_key").agg(F.min("sketch").alias("sketch")).groupBy("entity", "term", "n_e", "least", "sketch").agg(F.lit(1).alias("one"))
    near = near.groupBy("entity", "term", "n_e", "least").agg(F.count("*").alias("n_te"))
    trials = shown.agg(F.coalesce(F.sum(F.size("entities").cast("bigint") * F.size("terms")), F.lit(0)).alias("trials"))
    near = near.where((F.col("n_te") >= SUPPORT) & (F.col("n_te") >= CERTAINTY * (F.col("least") + 1)))
    return near.crossJoin(F.broadcast(trials)).drop("least")  # one row


def discloses(n: Column, n_e: Column, n_t: Column, n_te: Column, trials: Column) -> Column:
    """Of n texts n_e hold an entity, n_t a term, n_te unlike ones both, near each other: whether the term discloses the entity.

    With p(e | t) smoothed to n_te / (n_t + 1), it tells log(p(e | t) / p(e)) of -log p(e). By Chernoff's bound, chance gives a
    term n_te of its n_t texts near the entity with probability exp(-n_t KL(n_te / n_t, p(e))) at most; over all
    trials less than CHANCE such pairs are expected. An entity of all texts can't be told apart.
    """
    p, q, sure = n_e / n, n_te / n_t, n_te / (n_t + 1)
    told = 1 - F.log(sure) / F.log(p)
    evidence = n_t * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    return (n_te >= SUPPORT) & (n_e < n) & (sure >= CERTAINTY) & (q > p) & F.coalesce((told >= DISCLOSURE) & (evidence >= F.log(trials / CHANCE)), F.lit(False))


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(text_col))


def disclosing_terms(texts: DataFrame, holding: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, n, n_e, n_t, n_te, trials) of disclosing terms, and (text_key, term), the texts that name terms that may disclose.

    texts (line): all texts, not empty, repeats included; holding (line): the distinct ones with an entity.
    """
    pairs = durable(near_entities(holding))
    terms = durable(pairs.select("term").distinct())
    rows = texts.select(text_key("line").alias("text_key"), F.explode(words("line")).alias("term"))
    named = durable(rows.join(_small(terms, F.octet_length("term")), "term", "left_semi").distinct())
    n_t = named.groupBy("term").agg(F.count("*").alias("n_t"))
    n = texts.select(text_key("line").alias("text_key")).distinct().agg(F.count("*").alias("n"))
    judged = pairs.join(n_t, "term").crossJoin(F.broadcast(n))  # one row
    judged = judged.where(discloses(*(F.col(c) for c in ("n", "n_e", "n_t", "n_te", "trials"))))
    return judged.select("entity", "term", "n", "n_e", "n_t", "n_te", "trials"), named.select("text_key", "term")


def term_spans(texts: DataFrame) -> DataFrame:
    """(text_key, found): the spans, in order, of terms in texts (text_key, line, base_spans, terms) that no base span overlaps."""
    placed = texts.select("text_key", F.explode(F.expr(located("line", _WORD, "term"))).alias("s")).select("text_key", "s.start", "s.end", F.col("s.value").alias("value"))
    wanted = texts.select("text_key", F.explode("terms").alias("term"))
    hits = placed.join(wanted, (placed["text_key"] == wanted["text_key"]) & (F.lower("value") == F.col("term"))).select(placed["text_key"], "start", "end", "value", F.lit(True).alias("own"))
    base = texts.select("text_key", F.explode("base_spans").alias("s")).select("text_key", "s.start", "s.end", F.lit(None).cast("string"), F.lit(False))
    forth = Window.partitionBy("text_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("text_key").orderBy(F.desc("start"), "own")
    ordered = hits.union(base.toDF(*hits.columns)).withColumn("before", F.max(F.when(~F.col("own"), F.col("end"))).over(forth)).withColumn("after", F.min(F.when(~F.col("own"), F.col("start"))).over(back))
    clear = ordered.where(F.col("own") & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    span = F.struct("start", F.lit("term").alias("kind"), "end", "value")
    ordered = F.transform(F.array_sort(F.collect_list(span)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return clear.groupBy("text_key").agg(ordered.alias("found"))


def find_personal_data(docs: DataFrame, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """docs with base_spans and spans (array<struct<kind, start, end, value>>); spans adds the terms that disclose
    an entity of the corpus, kind `term`, where no base span overlaps them, whether or not the text holds the entity.

    Positions are code points, end exclusive. Null and empty texts have none. Repeated rows and null ids stay,
    and all other columns; columns named as the two results are replaced. Terms are counted over all texts; equal
    texts count once, near copies give no support. Without a pair that may disclose, texts aren't searched for terms.
    """
    key, found = fresh(docs, "text_key", "found")
    text = F.col(text_col)
    every = docs.select(text.alias("line")).where(F.length("line") > 0)
    holding = durable(every.where(F.col("line").rlike("[0-9@]")).where(F.size(base_spans("line")) > 0).distinct())
    rows = docs.withColumn(base_col, base_spans(text_col))
    told, named = disclosing_terms(every, holding)
    terms = durable(told.select("term").distinct())
    if terms.isEmpty():
        return rows.withColumn(spans_col, F.col(base_col))
    by_text = durable(named.join(_small(terms, F.octet_length("term")), "term", "left_semi").groupBy("text_key").agg(F.collect_set("term").alias("terms")))
    marked = every.select(text_key("line").alias("text_key"), "line").join(_small(by_text.select("text_key"), F.lit(32)), "text_key", "left_semi").dropDuplicates(["text_key"])
    marked = durable(marked.withColumn("base_spans", base_spans("line")).join(by_text, "text_key"))
    more = durable(term_spans(marked)).select(F.col("text_key").alias(key), F.col("found").alias(found))
    size = 64 * F.size(found) + F.lit(64)
    joined = rows.join(_small(more, size), text_key(text_col) == F.col(key), "left")
    return joined.withColumn(spans_col, F.when(F.col(found).isNull(), F.col(base_col)).otherwise(F.concat(base_col, found))).drop(key, found)


def redact(df: DataFrame, text_col: str = "text", labels: dict[str, str] = LABELS, spans_col: str = "spans") -> DataFrame:
    """df (with spans) whose texts have each span generalised to its kind's label; overlapping spans go under the first one's.

    A label of "" removes the span. Texts without spans, null ones too, stay as they are.
    """
    text, ordered = _name(text_col), f"array_sort(transform({_name(spans_col)}, s -> named_struct('start', s.start, 'back', -s.`end`, 'kind', s.kind)))"
    names = ", ".join(f"'{k}', '{v}'" for k, v in labels.items())
    # of overlapping spans the first one's label stands, and the text goes on after the furthest end so far
    piece = f"transform(array(if(i = 0, 0, get(far, i - 1))), at -> if(x.start < at, '', concat(substring({text}, at + 1, x.start - at), map({names})[x.kind])))[0]"
    clean = f"concat(array_join(transform(spans, (x, i) -> {piece}), ''), substring({text}, element_at(far, -1) + 1, length({text})))"
    whole = _bound(ordered, "spans", _bound(running("transform(spans, x -> -x.back)", "greatest({}, {})"), "far", clean))
    return df.withColumn(text_col, F.expr(f"if(size({_name(spans_col)}) > 0, {whole}, {text})"))
