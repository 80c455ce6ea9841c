"""Labelled values in lines: occurrences, reads, candidates, assignment, facts and run summaries.

Labels are found by an equi-join of each line's word n-grams with the label table (broadcast: it is the catalogue's,
checked against `MOST_LABELS`). Everything of a document is keyed by doc_id, so windows and groups hold one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfacts.functions import values
from docfacts.functions.text import NOT_ASCII, fold, fold_column, fold_in_place, folded_words, let, tokens_with_offsets
from docfacts.functions.validators import VALIDATORS, validate
from docfacts.sources import registry

#: Base confidences, penalties and the threshold of acceptance.
SAME_LINE, NEXT_LINE, COMPUTED, OCR_PENALTY, FAILURE_PENALTY, ACCEPT = 0.85, 0.80, 0.60, 0.10, 0.18, 0.85
#: Words that make a label near them a citation.
NORM_MARKERS = ["art", "artt", "articolo", "articoli", "comma", "decreto", "legge", "dlgs", "lgs", "dpr", "dm", "dl", "direttiva", "regolamento", "circolare"]
PRECEDING_MARKERS = ["via", "viale", "vicolo", "piazza", "piazzale", "corso", "largo", "atto", "deposito", "rif", "riferim", "riferimento", "ns", "vs"]
MOST_LABELS = 200_000
FEW_HEADS = 50  # so few are sought in a line's words before these are listed
MOST_HEADS = 10_000  # first words of labels that are written into the plan; with more, all runs of words are joined


def two_places(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def four_places(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def mean_of_hundredths(x: Column) -> Column:
    """Mean to four places of numbers with two, by whole numbers, so that the order of summing doesn't matter; null without any."""
    total, n = F.sum(F.round(x * 100).cast("long")), F.count(x)
    return F.when(n > 0, F.floor((total * 200 + n) / (n * 2)) / 10000)


def lines(pages: DataFrame, *more: str) -> DataFrame:
    """A row per line: doc_id, page, line, text, folded, next_text, text_source, document_type and the pages' columns `more`."""
    pairs = F.arrays_zip(F.col("lines").alias("text"), F.slice("lines", F.lit(2), F.size("lines")).alias("next_text"))  # no line carries its whole page
    rows = pages.select("doc_id", "page", "text_source", "document_type", *more, F.posexplode(pairs).alias("line", "l"))
    return rows.select("doc_id", "page", "text_source", "document_type", *more, "line", F.col("l.text").alias("text"), fold_column(F.col("l.text")).alias("folded"), F.col("l.next_text").alias("next_text"))


def with_sections(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds party: a heading of exactly one party opens its section, one of several closes it, other lines carry it on within the page."""
    owner = sections.groupBy(F.col("heading").alias("folded")).agg(F.collect_set("party").alias("parties"))
    change = F.when(F.size("parties") == 1, F.get("parties", F.lit(0))).when(F.size("parties") > 1, F.lit(""))
    carried = F.last(change, ignorenulls=True).over(Window.partitionBy("doc_id", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(owner), "folded", "left").withColumn("party", F.nullif(carried, F.lit(""))).drop("parties")


def with_runs(rows: DataFrame, longest: int, heads: list[str] | None = None) -> DataFrame:
    """Adds label and g = (first, n): a row per run of up to `longest` words of `folded`, or of those alone that begin with one of `heads`."""
    worded = rows.withColumn("_words", F.split("folded", " "))
    if heads is not None and 0 < len(heads) <= FEW_HEADS:  # a line without any isn't copied for each of its words
        worded = worded.where(F.arrays_overlap("_words", F.array(*[F.lit(h) for h in heads])))
    begun = worded.select("*", F.posexplode("_words").alias("_first", "_head"))
    begun = begun.where("_head <> ''" if heads is None else F.col("_head").isin(heads))
    runs = begun.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_words") - F.col("_first")))))
    label = F.array_join(F.slice("_words", F.col("_first") + 1, F.col("_n")), " ")
    return runs.withColumn("label", label).withColumn("g", F.struct(F.col("_first").alias("first"), F.col("_n").alias("n"))).drop("_words", "_first", "_head", "_n")


def word_span(text: Column, first: Column, last: Column) -> Column:
    """struct<start, end> of the folded words `first` to `last` of a text, as offsets in the text itself (0-based, end exclusive)."""

    def of(parts: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i) != "")
        begin, stop = F.get(full, first), F.get(full, last)
        upto = lambda i: F.length(F.array_join(F.slice(parts, 1, i), " "))
        return F.struct((upto(begin) + F.when(begin > 0, 1).otherwise(0)).alias("start"), upto(stop + 1).alias("end"))

    return let(F.split(fold_in_place(text), " "), of)


def label_span(text: Column, folded: Column, label: Column, g: Column) -> Column:
    """`word_span` of a label's run of words. Where a plain text holds the label once, its words a space apart, the place is simply sought."""
    within = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    first = F.call_function("instr", within(folded), within(label))
    once_only = F.call_function("locate", within(label), within(folded), first + 1) == 0
    at = F.call_function("instr", within(F.regexp_replace(F.lower(text), "[^a-z0-9]", " ")), within(label))
    plain = ~text.rlike(NOT_ASCII) & (first > 0) & once_only & (at > 0)
    return F.when(plain, F.struct((at - 1).alias("start"), (at - 1 + F.length(label)).alias("end"))).otherwise(word_span(text, g["first"], g["first"] + g["n"] - 1))


def met(rows: DataFrame, labels: DataFrame, longest: int, by: tuple[str, ...] = ("document_type",), few: bool = True, heads: list[str] | None = None) -> DataFrame:
    """`occurrences` with g = (first word, n words) alone."""
    return with_runs(rows, longest, heads).join(F.broadcast(labels) if few else labels, [*by, "label"])


def occurrences(rows: DataFrame, labels: DataFrame, longest: int, by: tuple[str, ...] = ("document_type",), few: bool = True, heads: list[str] | None = None) -> DataFrame:
    """Lines × labels: every place where a label of the document's type (or what else they share, `by`) stands between word boundaries, with g = (first word, n words, start, end).

    Only what matches gets its offsets computed. `longest` is the most words that a label of the catalogue has; `heads`, all first words of its labels, spares the runs that can't be one.
    """
    hits = met(rows, labels, longest, by, few, heads)
    hits = once(hits, "span", label_span(F.col("text"), F.col("folded"), F.col("label"), F.col("g")))
    return hits.withColumn("g", F.struct("g.first", "g.n", "span.start", "span.end")).drop("span")


#: Whether a folded text has any word that may make a label near it a citation.
ANY_MARKER = rf"(?<!\S)(?:{'|'.join(NORM_MARKERS + PRECEDING_MARKERS)})(?!\S)"


def cited(text: Column, first: Column, n: Column) -> Column:
    """Whether one of the three words before is a norm, address or reference marker, or one of the three after a norm marker."""

    def near(words: Column) -> Column:
        lettered = lambda part: F.filter(part, lambda w: w.rlike("[a-z]"))
        before = let(lettered(F.slice(words, 1, first)), lambda p: F.slice(p, F.greatest(F.size(p) - 2, F.lit(1)), F.lit(3)))
        after = F.slice(lettered(F.slice(words, first + n + 1, F.greatest(F.size(words) - first - n, F.lit(0)))), 1, 3)
        marks = lambda names: F.array(*[F.lit(x) for x in names])
        return F.arrays_overlap(before, marks(NORM_MARKERS + PRECEDING_MARKERS)) | F.arrays_overlap(after, marks(NORM_MARKERS))

    return F.coalesce(let(folded_words(text), near), F.lit(False))


def cited_line(text: Column, folded: Column, first: Column, n: Column) -> Column:
    """`cited`, looked at closely only where the folded line has any marker at all."""
    return F.coalesce(folded.rlike(ANY_MARKER), F.lit(False)) & cited(text, first, n)


def is_kind(type_: str, format_: str | None, scale: str | None) -> Column:
    return (F.col("type") == type_) & F.col("format").eqNullSafe(format_) & F.col("scale").eqNullSafe(scale)


def read_by_kind(text: Column, kinds: list[tuple], next_line: bool, kind: str | None = None) -> Column:
    """Each row's reader by its type, format and scale, or by their number among `kinds` (column `kind`)."""
    out = F.lit(None).cast("string")
    for i, (type_, format_, scale) in enumerate(kinds):
        mine = is_kind(type_, format_, scale) if kind is None else F.col(kind) == i
        out = F.when(mine, values.read_value(text, type_, format_, scale, ["EUR", "USD", "GBP", "CHF"], next_line)).otherwise(out)
    return out


def numbered(labels: DataFrame) -> tuple[DataFrame, list[tuple], list[tuple]]:
    """Labels with the numbers of their reader (kind) and of their validators (check) in place of what these are made of; all kinds; all lists of validators. Rows that are read carry numbers alone."""
    kinds = sorted({tuple(r) for r in labels.select("type", "format", "scale").distinct().collect()}, key=str)
    checks = sorted({tuple(r[0] or ()) for r in labels.select("validators").distinct().collect()})
    kind, check = F.lit(-1), F.lit(-1)
    for i, k in enumerate(kinds):
        kind = F.when(is_kind(*k), i).otherwise(kind)
    names = F.coalesce("validators", F.array().cast("array<string>"))
    for i, c in enumerate(checks):
        check = F.when(names == F.array(*[F.lit(n) for n in c]).cast("array<string>"), i).otherwise(check)
    return labels.withColumns({"kind": kind, "check": check}).drop("type", "format", "scale", "validators"), kinds, checks


def failures(value: Column, checks: list[tuple]) -> Column:
    """Codes of the field's validators (those of `checks` that the column `check` numbers) that reject the value, each once, in the order of `VALIDATORS`."""
    none = F.array().cast("array<string>")
    out = none
    for i, names in enumerate(checks):
        codes = [validate(n, value) for n in VALIDATORS if n in names]
        failed = F.array_except(F.array(*codes), F.array(F.lit(None).cast("string"))) if codes else none  # compiled, which array_compact isn't
        out = F.when(F.col("check") == i, failed).otherwise(out)
    return out


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column through a generator, over which the optimizer neither copies the expression nor pushes filters on it.

    The value is computed in a projection below: that is compiled, while a generator with a lambda anywhere inside is interpreted as a whole.
    """
    return df.select("*", value.alias("_once")).withColumn(name, F.explode(F.array("_once"))).drop("_once")


BARE = r"^[\s:=.°#\-–—]*"
AMOUNT = r"(?:\d{1,3}(?:[.\s]\d{3})*,\d{1,2}|\d+\.\d{1,2})"
#: Two amounts a column's gap apart: which column the field is can't be told.
COLUMNS = AMOUNT + r"(?:\s*(?:€|(?i:euro?)))?\s{3,}(?:€\s*)?" + AMOUNT
BILINGUAL = r"(?<!\S)\p{L}{3,}[/\\]\p{L}{3,}"
TRAILING_TAX_ID = r"(?i)(?<![A-Za-z0-9_])(?:(?:IT)?\d{11}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])$"


def with_twins(labels: DataFrame) -> DataFrame:
    """Adds twins, all labels of the same field, and others, those of the type's other fields: what a bilingual label's tail and the next column begin with."""
    twins = labels.groupBy("document_type", "field_id").agg(F.collect_set("label").alias("twins"))
    every = labels.groupBy("document_type").agg(F.collect_set("label").alias("every"))
    return labels.join(twins, ["document_type", "field_id"]).join(every, "document_type").withColumn("others", F.array_except("every", "twins")).drop("every")


def tail_parts(rest: Column) -> Column:
    """The parts of a label's tail, "/SURNAME/NOM", without blank ones; none if no slash follows the label."""
    bare = F.regexp_replace(rest, BARE, "")
    return F.when(bare.rlike(r"^[/\\]"), F.filter(F.split(bare, r"[/\\]"), lambda x: F.trim(x) != ""))


def ends_label_line(rest: Column) -> Column:
    """Whether nothing but marks, or only twins of the label, stand after it."""
    parts = tail_parts(rest)
    twins = parts.isNotNull() & (F.size(parts) > 0) & F.forall(parts, lambda x: F.array_contains("twins", fold(x)))
    return rest.rlike(BARE + "$") | F.coalesce(twins, F.lit(False))


def after_twin(rest: Column) -> Column:
    """Text after a label's twins, up to the next column: another field's label or a bilingual word. Null without a twin, or where nothing follows."""

    def of(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        twin = F.array_max(F.transform(F.filter("twins", lambda t: F.call_function("startswith", fold(last), F.concat(t, F.lit(" ")))), lambda t: F.size(F.split(t, " "))))
        start = F.get(tokens_with_offsets(last), twin)["at"]
        ok = F.forall(before, lambda x: F.array_contains("twins", fold(x))) & twin.isNotNull()
        return F.when(ok, F.substring(last, start + 1, F.length(last)))

    # a slash inside the value's own columns belongs to the next column's bilingual word: cut there first
    head = F.regexp_replace(rest, r"(?<=\s)\p{L}{3,}[/\\]\p{L}{3,}.*$", "")
    text = let(tail_parts(head), lambda p: F.when(F.size(p) > 0, of(p)))

    def cut(value: Column) -> Column:
        folded = F.concat(F.lit(" "), F.regexp_replace(F.lower(value), "[^a-z0-9]", " "), F.lit(" "))
        starts = F.filter(F.transform("others", lambda o: F.call_function("instr", folded, F.concat(F.lit(" "), o, F.lit(" "))) - 1), lambda i: i > 0)
        return F.substring(value, F.lit(1), F.coalesce(F.array_min(starts), F.length(value)))

    return let(text, cut)


def reads(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per label occurrence with a value: on the same line, else after the label's twins, else on the next line of the page."""
    catalogue = labels.select("words", F.substring_index("label", " ", 1).alias("head")).distinct().collect()
    longest, heads = max((r["words"] for r in catalogue), default=1), sorted({r["head"] for r in catalogue})
    own, kinds, checks = numbered(labels)
    of_type = lambda name: F.col("kind").isin([i for i, k in enumerate(kinds) if k[0] == name])
    found = occurrences(rows, own.drop("words"), longest, heads=heads if len(heads) <= MOST_HEADS else None)
    before, rest = F.rtrim(F.substring("text", F.lit(1), F.col("g.start"))), F.substring(F.col("text"), F.col("g.end") + 1, F.length("text"))
    opens = (before == "") | before.rlike("[-–—|;•(]$") | ((F.trim(rest) == "") & before.rlike(TRAILING_TAX_ID)) | rest.rlike(BARE + r"[/\\]")
    party = F.substring_index("field_id", ".", 1)
    found = found.where((~of_type("string") | opens) & (~party.isin("issuer", "recipient") | F.col("party").isNull() | (party == F.col("party"))))
    found = once(found, "cited", cited_line(F.col("text"), F.col("folded"), F.col("g.first"), F.col("g.n"))).where("not cited").withColumn("rest", rest)
    direct = F.when(~(of_type("money") & F.col("rest").rlike(r"\s{3}") & F.col("rest").rlike(COLUMNS)), read_by_kind(F.col("rest"), kinds, False, "kind"))
    tail = F.when(F.col("rest").rlike(BARE + r"[/\\]"), after_twin(F.col("rest")))
    found = once(found, "direct", direct)
    twins = with_twins(labels).select(F.col("document_type").alias("_type"), F.col("field_id").alias("_field"), F.col("label").alias("_label"), "twins", "others")
    same = (F.col("document_type") == F.col("_type")) & (F.col("field_id") == F.col("_field")) & (F.col("label") == F.col("_label"))
    found = found.join(F.broadcast(twins), same & F.col("direct").isNull(), "left").drop("_type", "_field", "_label")  # rows that are read carry no lists of labels
    found = once(found, "tail", F.when(F.col("direct").isNull(), tail))
    found = once(found, "here", F.coalesce("direct", F.when(F.col("tail").isNotNull(), read_by_kind(F.col("tail"), kinds, True, "kind"))))
    ends = F.col("here").isNull() & F.col("next_text").isNotNull() & ends_label_line(F.col("rest"))
    below = F.when(ends, F.struct(read_by_kind(F.col("next_text"), kinds, True, "kind").alias("value"), fold(F.col("next_text")).alias("bare")))
    read = once(found, "below", below).withColumn("value", F.coalesce("here", "below.value")).where("value is not null").withColumn("bare", F.col("below.bare"))
    known = labels.select("document_type", F.col("label").alias("bare")).distinct()
    read = read.join(F.broadcast(known), ["document_type", "bare"], "left_anti")
    read = once(read.withColumn("same_line", F.col("here").isNotNull()), "errors", failures(F.col("value"), checks))
    base = F.when(F.col("same_line"), SAME_LINE).otherwise(NEXT_LINE) - F.when(F.col("text_source") == "OCR", OCR_PENALTY).otherwise(0.0) - FAILURE_PENALTY * F.size("errors")
    read = read.withColumn("confidence", two_places(F.greatest(base, F.lit(0.0)))).withColumn("value_line", F.col("line") + F.when(F.col("same_line"), 0).otherwise(1))
    return read.select("doc_id", "document_type", "field_id", "role", "ord", "cardinality", "value", "tier", "label", "same_line", "errors", "confidence", "page", "value_line", "text")


def candidates(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Best candidate per document, field, page, value line and value."""
    best = Window.partitionBy("doc_id", "field_id", "page", "value_line", "value").orderBy(rank_key())
    return reads(rows, labels).withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def rank_key() -> Column:
    """Order of candidates: tier, label length, same line, fewer failures, document order; then the profile's order."""
    return F.struct(-F.col("tier"), -F.length("label"), (~F.col("same_line")).cast("int"), F.size("errors"), F.col("page"), F.col("value_line"), F.col("ord"))


def walks(found: DataFrame) -> DataFrame:
    """doc_id, document_type, walk: each document's candidates in rank order. A document's candidates are few: labels times lines that hold them.

    alone: whether every single-valued field has one candidate and no two of them share a value on a line; apart: whether repeated fields have one a line.
    """
    item = F.struct(rank_key().alias("k"), "field_id", "role", "cardinality", "value", "confidence", "errors", "page", "value_line", "text", F.length("label").alias("length"), "tier")
    one, many = F.col("cardinality") == "one", F.col("cardinality") == "many"
    fields, places = F.collect_set(F.when(one, F.col("field_id"))), F.collect_set(F.when(one, F.struct("page", "value_line", "value")))
    alone = (F.size(fields) == F.count_if(one)) & (F.size(places) == F.count_if(one))
    apart = F.size(F.collect_set(F.when(many, F.struct("field_id", "page", "value_line")))) == F.count_if(many)
    return found.groupBy("doc_id", "document_type").agg(F.sort_array(F.collect_list(item)).alias("walk"), alone.alias("alone"), apart.alias("apart"))


def assign(walk: Column) -> Column:
    """The greedy walk over the candidates of single-valued fields, as a fold: struct<chosen map<field, index>, claims, shared array<field>, i>.

    A field takes its first candidate whose value line isn't claimed by a more specific one; two as specific share it and conflict.
    """
    entry = "struct<field:string,tier:int,length:int>"
    init = F.struct(
        F.expr("cast(map() as map<string,int>)").alias("chosen"), F.expr(f"cast(map() as map<string,{entry}>)").alias("claims"), F.array().cast("array<string>").alias("shared"), F.lit(0).alias("i")
    )

    def step(acc: Column, c: Column) -> Column:
        key = F.concat_ws(":", c["page"].cast("string"), c["value_line"].cast("string"), c["value"])
        owner = F.try_element_at(acc["claims"], key)
        stronger = (owner["tier"] > c["tier"]) | ((owner["tier"] == c["tier"]) & (owner["length"] > c["length"]))
        skip = (c["cardinality"] != "one") | F.map_contains_key(acc["chosen"], c["field_id"]) | F.coalesce(stronger, F.lit(False))
        claim = F.struct(c["field_id"].alias("field"), c["tier"].alias("tier"), c["length"].cast("int").alias("length"))
        chosen = F.map_concat(acc["chosen"], F.map_from_arrays(F.array(c["field_id"]), F.array(acc["i"])))
        claims = F.when(owner.isNotNull(), acc["claims"]).otherwise(F.map_concat(acc["claims"], F.map_from_arrays(F.array(key), F.array(claim))))
        shared = F.when(owner.isNull(), acc["shared"]).otherwise(F.array_union(acc["shared"], F.array(owner["field"], c["field_id"])))
        taken = F.struct(chosen.alias("chosen"), claims.alias("claims"), shared.alias("shared"), (acc["i"] + 1).alias("i"))
        return F.when(skip, F.struct(acc["chosen"].alias("chosen"), acc["claims"].alias("claims"), acc["shared"].alias("shared"), (acc["i"] + 1).alias("i"))).otherwise(taken)

    return F.aggregate(walk, init, step)


def lone_facts(walk: Column) -> Column:
    """What `one_facts` gives where every field has one candidate and none claims another's place: all of them, without conflicts."""

    def fact(c: Column) -> Column:
        return F.struct(
            c["field_id"].alias("field_id"), F.array(c["value"]).alias("values"), c["confidence"].alias("confidence"), c["errors"].alias("errors"), c["page"].alias("page"), c["value_line"].alias("line"), c["text"].alias("evidence"),
            F.lit(False).alias("conflict"),
        )

    return F.transform(F.filter(walk, lambda c: c["cardinality"] == "one"), fact)


def one_facts(walk: Column, end: Column) -> Column:
    """array of facts of the single-valued fields that were assigned."""

    def fact(e: Column) -> Column:
        def of(c: Column) -> Column:
            rivals = F.exists(walk, lambda w: (w["field_id"] == c["field_id"]) & (w["tier"] == c["tier"]) & (w["length"] == c["length"]) & (w["value"] != c["value"]))
            return F.struct(
                c["field_id"].alias("field_id"), F.array(c["value"]).alias("values"), c["confidence"].alias("confidence"), c["errors"].alias("errors"), c["page"].alias("page"), c["value_line"].alias("line"), c["text"].alias("evidence"),
                (rivals | F.array_contains(end["shared"], c["field_id"])).alias("conflict"),
            )

        return let(F.get(walk, e["value"]), of)

    return F.transform(F.map_entries(end["chosen"]), fact)


def many_facts(walk: Column, apart: Column | None = None) -> Column:
    """array of facts of repeated fields: the first candidate of each line, in document order; the mean confidence. Where they are known to stand `apart`, none is looked for on the same line."""
    repeated = F.filter(walk, lambda c: c["cardinality"] == "many")

    def fact(field: Column) -> Column:
        own = F.filter(repeated, lambda c: c["field_id"] == field)
        place = lambda c: F.struct(c["page"], c["value_line"])
        first = F.filter(own, lambda c, i: ~F.array_contains(F.transform(F.slice(own, 1, i), place), place(c)))
        first = first if apart is None else F.when(apart, own).otherwise(first)
        ordered = F.sort_array(F.transform(first, lambda c: F.struct(c["page"].alias("page"), c["value_line"].alias("line"), c["value"].alias("value"), c["text"].alias("text"), c["confidence"].alias("confidence"), c["errors"].alias("errors"))))

        def of(items: Column) -> Column:
            head = F.get(items, F.lit(0))
            mean = F.aggregate(items, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(items)
            return F.struct(
                field.alias("field_id"), F.transform(items, lambda x: x["value"]).alias("values"), two_places(mean).alias("confidence"), F.array_distinct(F.flatten(F.transform(items, lambda x: x["errors"]))).alias("errors"), head["page"].alias("page"), head["line"].alias("line"), head["text"].alias("evidence"),
                F.lit(False).alias("conflict"),
            )

        return let(ordered, of)

    return F.transform(F.array_distinct(F.transform(repeated, lambda c: c["field_id"])), fact)


def facts(pages: DataFrame, spark: SparkSession, learned: DataFrame | None = None) -> DataFrame:
    """A row per document and field of its type's profile, found or not; every document has a page 1."""
    labels = registry.labels(spark, learned)
    if (n := labels.count()) > MOST_LABELS:
        raise ValueError(f"{n} labels are too many to broadcast")
    pages = pages.repartition("doc_id")  # the one shuffle: sections, candidates and facts all keep to it
    rows = with_sections(lines(pages), registry.sections(spark))
    walk, end = F.col("walk"), F.col("end")
    folded = once(walks(reads(rows, labels)), "end", F.when(~F.col("alone"), assign(walk)))
    read = once(folded, "facts", F.concat(F.when(F.col("alone"), lone_facts(walk)).otherwise(one_facts(walk, end)), many_facts(walk, F.col("apart")))).select("doc_id", "facts")
    profiles = registry.profiles(spark)
    asked = profiles.groupBy("document_type").agg(F.collect_list("field_id").alias("asked"))
    # a document's facts and the fields that it lacks come from one row: no join by document and field
    wanted = pages.where("page = 1").select("doc_id", "document_type").hint("shuffle_hash").join(read, "doc_id", "left").join(F.broadcast(asked), "document_type")
    empty = F.array().cast(read.schema["facts"].dataType)
    facts_ = F.coalesce("facts", empty)
    nothing = F.transform(F.array_except("asked", facts_["field_id"]), lambda f: F.struct(f.alias("field_id"), *[F.lit(None).cast(x.dataType).alias(x.name) for x in read.schema["facts"].dataType.elementType.fields[1:]]))
    every = wanted.select("doc_id", "document_type", F.explode(F.concat(facts_, nothing)).alias("f")).select("doc_id", "document_type", "f.*")
    every = every.join(F.broadcast(profiles), ["document_type", "field_id"])
    every = every.select("doc_id", "field_id", "document_type", "role", "ord", "values", "confidence", "errors", "page", "line", "evidence", "conflict")
    status = F.when(F.col("values").isNull(), "MISSING").when(F.col("conflict"), "CONFLICT").when((F.size("errors") > 0) | (F.col("confidence") < ACCEPT), "NEEDS_REVIEW").otherwise("AUTO_ACCEPTED")
    return every.withColumn("status", status)


def run_summary(fact_rows: DataFrame) -> DataFrame:
    """Per document: coverage, mean confidence of the filled fields, missing required fields, conflicts, counts of statuses."""
    filled = F.col("values").isNotNull()
    return fact_rows.groupBy("doc_id", "document_type").agg(
        two_places(F.count_if(filled) / F.count("*")).alias("coverage"),
        F.coalesce(mean_of_hundredths(F.when(filled, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
        F.array_join(F.array_sort(F.collect_list(F.when(~filled & (F.col("role") == "required"), F.col("field_id")))), ",").alias("missing_required"),
        F.count_if(F.col("status") == "CONFLICT").alias("conflicts"),
        F.count_if(F.col("status") == "AUTO_ACCEPTED").alias("accepted"),
        F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"),
    )


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "HIGH").when(confidence >= 0.75, "MEDIUM").otherwise("LOW")
