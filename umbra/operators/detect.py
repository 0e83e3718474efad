"""Detection: spans by rules and shapes, labels, bindings, merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from umbra.functions.rules import CARD_PREFIX, CONTEXT_RULES, MOST_WORDS, RULES, SHAPES, UPI_HANDLES, VERHOEFF_D, VERHOEFF_P, Rule

MARKS = "\x01\x02"


def verhoeff_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Verhoeff check."""
    numbered = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.pmod(i, F.lit(8)) * 10 + d.cast("int"))
    step = lambda c, x: F.substring(F.lit(VERHOEFF_D), c * 10 + F.substring(F.lit(VERHOEFF_P), x + 1, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")
    return digits.rlike("^[0-9]+$") & (F.aggregate(numbered, F.lit(0), step) == 0)


def luhn_valid(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


#: Places are summed up in blocks of so many pieces, so that thousands of matches in one text cost little more than so many times a few.
BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def starts(sizes: Column) -> Column:
    """array<int>: the sum of all sizes before each one: those of whole blocks of blocks, of whole blocks, and of the block itself."""

    def summed(x: Column, width: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / width).cast("int")), lambda b: F.aggregate(F.slice(x, b * width + 1, F.lit(width)), F.lit(0), lambda a, y: a + y))

    def upto(x: Column, first: Column, i: Column) -> Column:
        return F.aggregate(F.slice(x, first + 1, i - first), F.lit(0), lambda a, y: a + y)

    def of(sums: Column) -> Column:
        def start(i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            c = F.floor(b / BLOCK).cast("int")
            return upto(sums.tops, F.lit(0), c) + upto(sums.blocks, c * BLOCK, b) + upto(sums.sizes, b * BLOCK, i)

        return F.transform(sums.sizes, lambda _, i: start(i))

    blocks = _let(sizes, lambda x: F.struct(x.alias("sizes"), summed(x, BLOCK).alias("blocks")))
    return _let(blocks, lambda s: _let(F.struct(s.sizes.alias("sizes"), s.blocks.alias("blocks"), summed(s.blocks, BLOCK).alias("tops")), of))


def _spans(p: Column) -> Column:
    """array<struct<span_start, span_end, value, next>> from the pieces of a text, of which every second one is a match."""

    def placed(at: Callable[[Column], Column]) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: (F.pmod(i, F.lit(2)) == 1) & (i < F.size(p)))
        return F.transform(ends, lambda i: F.struct(at(i).alias("span_start"), (at(i) + F.length(p[i])).alias("span_end"), p[i].alias("value"), F.substring(p[i + 1], 1, 1).alias("next")))

    few = placed(lambda i: F.length(F.array_join(F.slice(p, F.lit(1), i), "")))
    return F.when(F.size(p) <= BLOCK, few).otherwise(_let(starts(F.transform(p, F.length)), lambda at: placed(lambda i: at[i])))


def _pieces(rule: Rule) -> Column:
    """The pieces of `text` between and inside the matches of a rule, or null where it has none.

    A rule's hint is a pattern that every match has in it and that most texts lack. A mark is put before and behind each match, and the text is split at them.
    """
    text, pattern, hint = F.col("text"), rule.spark_pattern, rule.hint
    marked = F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1]))
    clean = F.when(marked, F.translate(text, MARKS, "  ")).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, pattern, f"{MARKS[0]}$0{MARKS[0]}"), MARKS[0], -1)
    probable = F.contains(text, F.lit(hint)) if hint.isalpha() or hint == "@" else text.rlike(hint or pattern)
    on = probable & text.rlike(pattern) if hint else text.rlike(pattern)
    return F.when((F.col("context") == rule.context) & on if rule.context else on, pieces)


def _valid(rules: tuple[Rule, ...]) -> Column:
    """Whether a match (columns n, value and next) passes its rule's check."""
    value, digits = F.col("value"), F.regexp_replace("value", "[ -]", "")
    checks = {
        "verhoeff": verhoeff_valid(digits), "digit": value.rlike("[0-9]"), "letter_digit": value.rlike("[0-9]") & value.rlike("[A-Za-z]"),
        "card": F.length(digits).between(13, 19) & luhn_valid(digits) & digits.rlike(CARD_PREFIX),
        "upi": F.col("next") != ".", "not_bh": ~F.upper(value).contains("BH"),
    }
    out = F.lit(True)
    for name in sorted({r.check for r in rules if r.check}):
        out = F.when(F.col("n").isin(*[i for i, r in enumerate(rules) if r.check == name]), checks[name]).otherwise(out)
    return out


def scan(units: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("unit_id", "origin")) -> DataFrame:
    """(unit_id, origin, rule, category, span_start, span_end, value, confidence): every valid match of every rule.

    One pass over the units and no shuffle: each rule looks for its hint first, then for a match, and only what it found is taken
    apart. Rules with a context only read units whose `context` is theirs. A null text holds nothing.
    """
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("n"), _pieces(rule).alias("p")) for i, rule in enumerate(rules)]), lambda r: r.p.isNotNull())
    spans = F.transform(found, lambda r: F.transform(_spans(r.p), lambda m: F.struct(r.n.alias("n"), m.span_start.alias("span_start"), m.span_end.alias("span_end"), m.value.alias("value"), m.next.alias("next"))))
    rows = units.select(*keep, F.inline_outer(F.flatten(spans))).where(F.col("n").isNotNull() & _valid(rules))  # before an inner one Spark filters by its size, which scans every text once more
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("n") + 1)
    confidence = of([float(r.confidence) for r in rules])
    if handles := [i for i, r in enumerate(rules) if r.check == "upi"]:
        known = F.lower(F.element_at(F.split("value", "@"), -1)).isin(*UPI_HANDLES)
        confidence = F.when(F.col("n").isin(*handles), F.when(known, 0.9).otherwise(0.55)).otherwise(confidence)
    return rows.select(*keep, of([r.name for r in rules]).alias("rule"), of([r.category for r in rules]).alias("category"), "span_start", "span_end", "value", confidence.alias("confidence"))


def scan_context_rules(units: DataFrame, keep: tuple[str, ...] = ("unit_id", "origin")) -> DataFrame:
    """Matches of the rules that need a label; units: unit_id, origin, context, text. A DOB context has dates of its own name."""
    dob = units.where("context = 'DOB'").withColumn("context", F.lit("DATE"))
    return scan(units, CONTEXT_RULES, keep).unionByName(scan(dob, tuple(r for r in CONTEXT_RULES if r.name == "date"), keep).withColumn("category", F.lit("DOB")))


def find_shapes(units: DataFrame) -> DataFrame:
    """Label-free shapes: weak or structured candidates for the evidence layer."""
    found = scan(units, SHAPES)
    digits = F.regexp_replace("value", "[ -]", "")
    return found.where(~((F.col("rule") == "digits_12") & verhoeff_valid(digits)) & ~((F.col("rule") == "digits_9_18") & luhn_valid(digits)))


def plain_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"""[.,;:!?'"()\[\]{}/\\_-]""", " "), r"\s+", " "))


def match_labels(texts: DataFrame, labels: DataFrame, key: str = "unit_id") -> DataFrame:
    """(key, category, phrase, phrase_len, rank): dictionary hits of each text, the most specific first.

    Own words count before generic heads (name, number, ...), longer phrases before shorter ones. Latin phrases meet
    runs of words by equality; others may stand inside words and are looked for in texts with such letters alone.
    """
    plain = texts.select(key, plain_label(F.col("text")).alias("__label"))
    words = F.split("__label", " ")

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*[runs(n) for n in range(1, MOST_WORDS + 1)]))
    latin = F.col("phrase").rlike("^[a-z0-9 ]+$")
    one = plain.select(key, F.explode_outer(F.array_distinct(every)).alias("phrase")).join(F.broadcast(labels.where(latin)), "phrase")  # labels: the fixed dictionary
    two = plain.where(F.col("__label").rlike(r"[^\x00-\x7F]")).join(F.broadcast(labels.where(~latin)), F.col("__label").contains(F.col("phrase")))
    columns = [key, "category", "phrase", "phrase_len", "is_generic", "is_override", "ord"]
    hits = one.select(*columns).unionByName(two.select(*columns))
    order = Window.partitionBy(key, "category").orderBy("is_generic", F.desc("phrase_len"), F.desc("is_override"), "ord")
    best = hits.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("is_generic", F.desc("phrase_len"), F.desc("is_override"), "ord"))).select(key, "category", "phrase", "phrase_len", "rank")


# How far an inline key and its value reach, and what ends a value.
KEY_WORDS, VALUE_CHARS = 6, 64
CLAUSE_END = r"(?s)^(.*?)(?:,\s+and\s+|[;.]\s+|[.;]\z)"


def _ordered_labels(labels: DataFrame) -> DataFrame:
    """One row with the dictionary as __labels: an array, the most specific phrase first, as match_labels ranks them.

    A needle is what a label with a space before and behind it has in it if the phrase is in the label.
    """
    latin = F.col("phrase").rlike("^[a-z0-9 ]+$")
    usable = labels.where(~latin | (F.size(F.split("phrase", " ")) <= MOST_WORDS))
    needle = F.when(latin, F.concat(F.lit(" "), "phrase", F.lit(" "))).otherwise(F.col("phrase"))
    order = ("is_generic", (-F.col("phrase_len")).alias("longest"), (~F.col("is_override")).alias("plain"), "ord")
    return usable.agg(F.array_sort(F.collect_list(F.struct(*order, "category", needle.alias("needle"), latin.alias("latin")))).alias("__labels"))


def bind_inline_key_values(units: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """(unit_id, category, key_end, value_start, value_end): every `label: value` in a text; keep names the columns that stay.

    A key is one to six words before a colon, none of them beyond a mark that ends a clause; of those that the
    dictionary knows the one with the longest phrase counts, then the shortest. A value goes up to the end of its
    clause, 64 characters at most. A colon inside the value before it binds nothing. All of a text is worked out in
    its row: nothing is shuffled, and only the dictionary is broadcast.
    """
    words = lambda piece: F.split(F.trim(F.regexp_replace(F.regexp_extract(piece, r"[^.,;\n]*$", 0), r"\s+", " ")), " ")

    def named(w: Column) -> Column:
        """The category of the last words before a colon, the last one first; null if the dictionary knows none of them."""
        tail = lambda n: F.array_join(F.reverse(F.slice(w, F.lit(1), n)), " ")
        padded = lambda text: F.concat(F.lit(" "), plain_label(text), F.lit(" "))

        def top(hits: Column, n: Column, label: Column) -> Column:
            first = F.get(F.filter(hits, lambda d: F.contains(label, d.needle) & (d.latin | label.rlike(r"[^\x00-\x7F]"))), F.lit(0))
            return _let(first, lambda d: F.when(d.isNotNull(), F.struct(d.longest.alias("longest"), n.alias("n"), d.category.alias("category"))))

        def best(hits: Column) -> Column:
            tops = F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: _let(tail(n), lambda text: F.when(F.length(text) >= 2, _let(padded(text), lambda label: top(hits, n, label)))))
            return F.when(F.size(hits) > 0, F.array_min(tops).category)

        # what fewer words have in them all of them have, so the dictionary is gone through once
        return _let(_let(padded(tail(F.lit(KEY_WORDS))), lambda every: F.filter("__labels", lambda d: F.contains(every, d.needle))), best)

    def bound(p: Column) -> Column:
        """Each colon with the category of its key and the place of its value; the text stays behind."""
        heads = F.transform(p, lambda x: F.substring(x, 1, VALUE_CHARS))

        def valued(at: Column, heads: Column, i: Column, category: Column) -> Column:
            lead = F.length(F.regexp_extract(p[i], r"^\s*", 0))
            rest = F.concat(F.substring(p[i], lead + 1, F.lit(VALUE_CHARS)), F.when(i + 1 < F.size(p), F.concat(F.lit(":"), F.array_join(F.slice(heads, i + 2, F.lit(VALUE_CHARS)), ":"))).otherwise(""))
            length = _let(F.substring(rest, 1, VALUE_CHARS), lambda w: F.when(w.rlike(CLAUSE_END), F.length(F.regexp_extract(w, CLAUSE_END, 1))).otherwise(F.length(w)))
            start = at[i] + lead
            return F.struct((at[i] - 1).alias("key_end"), category.alias("category"), start.alias("value_start"), (start + length).alias("value_end"))

        def colon(at: Column, heads: Column, i: Column) -> Column:
            category = _let(F.slice(F.reverse(words(p[i - 1])), 1, KEY_WORDS), named)
            return _let(category, lambda c: F.when(c.isNotNull(), valued(at, heads, i, c)))

        sizes = F.transform(p, lambda x: F.length(x) + 1)
        few = F.transform(p, lambda x, i: F.length(F.array_join(F.slice(p, F.lit(1), i), "")) + i)
        every = lambda s: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: colon(s.at, s.heads, i))
        return _let(F.struct(F.when(F.size(p) <= BLOCK, few).otherwise(starts(sizes)).alias("at"), heads.alias("heads")), every)

    def kept(b: Column) -> Column:
        """Bindings, in the order of their places, without those whose colon is in the value of one before."""
        none = F.struct(F.lit(0).alias("cursor"), F.slice(b, 1, 0).alias("kept"))
        step = lambda a, x: F.when(x.key_end >= a.cursor, F.struct(x.value_end.alias("cursor"), F.concat(a.kept, F.array(x)).alias("kept"))).otherwise(a)
        return F.aggregate(b, none, step, lambda a: a.kept)

    split = F.split("text", "[:：]", -1)
    found = F.filter(_let(split, bound), lambda x: x.isNotNull() & (x.value_end > x.value_start))
    rows = units.where(F.col("text").rlike("[:：]")).crossJoin(F.broadcast(_ordered_labels(labels)))
    return rows.select(*keep, F.inline_outer(_let(found, kept))).where("key_end is not null").select(*keep, "category", "key_end", "value_start", "value_end")


def field_context(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit_id, category, confidence): what a filled field is for; fields: unit_id, input_type, autocomplete, name, label, attr, value.

    A password field is one; then a pin code by its autocomplete category; then what the name, the label or the
    attribute say, in this order; then any other autocomplete category.
    """
    filled = fields.where(F.coalesce("value", F.lit("")) != "")
    said = filled.select("unit_id", F.posexplode(F.array("name", "label", "attr")).alias("place", "text")).where("text <> ''")
    top = match_labels(said.select(F.struct("unit_id", "place").alias("k"), "text"), labels, "k").where("rank = 1").groupBy(F.col("k.unit_id").alias("unit_id")).agg(F.min_by("category", "k.place").alias("said"))
    category = F.when(F.col("input_type") == "password", "PASSWORD").when(F.col("autocomplete") == "PIN_CODE", "PIN_CODE").otherwise(F.coalesce("said", "autocomplete"))
    return filled.join(top, "unit_id", "left").select("unit_id", category.alias("category"), F.lit(0.7).alias("confidence")).where("category is not null")


def places(text: Column, pattern: Column) -> Column:
    """array<struct<span_start, span_end>> of the matches of a pattern that differs by row, in code points."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def spans(p: Column) -> Column:
        sizes = F.transform(p.gaps, lambda g, i: F.length(g) + F.coalesce(F.length(F.get(p.found, i)), F.lit(0)))
        place = lambda at: F.transform(p.found, lambda m, i: F.struct((at[i] + F.length(p.gaps[i])).alias("span_start"), (at[i] + F.length(p.gaps[i]) + F.length(m)).alias("span_end")))
        return _let(starts(sizes), place)

    return _let(F.struct(found.alias("found"), gaps.alias("gaps")), spans)


def unscanned_media(media: DataFrame) -> DataFrame:
    """(page_id, seq, category, confidence): every medium that is seen and can't be read."""
    return media.where("hidden is null").select("page_id", "seq", F.lit("UNSCANNED_MEDIA").alias("category"), F.lit(1.0).alias("confidence"))


def bind_leading_key(units: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit_id, category, label, value): texts that begin with `key: value`, the key of 2 to 40 characters."""
    pattern = r"(?s)^\s*([^:\n]{2,40}):\s*(\S.*)$"
    keyed = units.where(F.col("text").rlike(pattern)).select("unit_id", F.regexp_extract("text", pattern, 1).alias("label"), F.regexp_extract("text", pattern, 2).alias("value"))
    top = match_labels(keyed.withColumnRenamed("label", "text"), labels).where("rank = 1").select("unit_id", "category")
    return keyed.join(top, "unit_id").select("unit_id", "category", "label", "value")


def pair_adjacent_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit_id, context): a cell or definition takes the category of the header or term right before it."""
    order = Window.partitionBy("origin").orderBy("seq")
    before = blocks.withColumns({"__role": F.lag("role").over(order), "__text": F.lag("text").over(order)})
    pairs = before.where(F.col("role").isin("definition", "cell") & F.col("__role").isin("term", "rowheader", "columnheader")).select("unit_id", F.col("__text").alias("text"))
    return match_labels(pairs, labels).where("rank = 1").select("unit_id", F.col("category").alias("context"))


def repeat_index(shapes: DataFrame) -> DataFrame:
    """shapes with n_targets: how many units of an origin carry the same value, spaces and case aside."""
    value = F.lower(F.regexp_replace("value", r"\s", ""))
    counts = shapes.groupBy("origin", value.alias("__v")).agg(F.count_distinct("unit_id").alias("n_targets")).withColumnRenamed("origin", "__o")
    return shapes.join(counts.hint("merge"), (F.col("origin") == F.col("__o")) & (value == F.col("__v"))).drop("__o", "__v")


def merge_spans(detections: DataFrame, policy: DataFrame) -> DataFrame:
    """(unit_id, origin, span_start, span_end, category, confidence, certainty, rules, value): overlapping spans of a unit as one.

    Spans chain into islands. A certain member (confidence 0.6 or more, or a certainty of 'detected' where detections
    have that column) makes the island certain, and then only certain ones name it: a secret first, then an explicit
    field context (source 'field_context'), then the class with the least risk rank, then the earliest span. The
    confidence is that of not all being wrong. value is that of a member that covers the island, else null.
    """
    has = set(detections.columns)
    sure = F.coalesce(F.col("certainty") == "detected", F.lit(False)) if "certainty" in has else F.col("confidence") >= 0.6
    place = F.when(F.col("category") == "SECRET", 0).when(F.col("source") == "field_context", 1).otherwise(2) if "source" in has else F.when(F.col("category") == "SECRET", 0).otherwise(2)
    detections = detections.withColumns({"__unsure": (~sure).cast("int"), "__place": place})
    ranked = detections.join(F.broadcast(policy.select("category", "risk_rank")), "category", "left").fillna(99, "risk_rank")
    order = Window.partitionBy("unit_id").orderBy("span_start", "span_end", "rule")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranked.withColumn("__new", (reach.isNull() | (F.col("span_start") >= reach)).cast("int")).withColumn("__island", F.sum("__new").over(order))
    doubt = F.aggregate(F.sort_array(F.collect_list("confidence")), F.lit(1.0), lambda a, c: a * (1 - c))
    return islands.groupBy("unit_id", "origin", "__island").agg(
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"),
        F.min_by("category", F.struct("__unsure", "__place", "risk_rank", "span_start", "rule")).alias("category"), F.round(1 - doubt, 6).alias("confidence"),
        F.when(F.min("__unsure") == 0, "detected").otherwise("uncertain").alias("certainty"),
        F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"),
        F.when(F.max(F.col("span_end") - F.col("span_start")) == F.max("span_end") - F.min("span_start"), F.max_by("value", F.col("span_end") - F.col("span_start"))).alias("value"),
    ).drop("__island")


def detection_stats(detections: DataFrame) -> DataFrame:
    """(category, n, n_units, n_certain): counts by category, certain from 0.6 on."""
    return detections.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_id").alias("n_units"), F.count_if(F.col("confidence") >= 0.6).alias("n_certain"))


def drop_structural_values(detections: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """detections whose value is neither the label of its own unit (texts: unit_id, label) nor a phrase of the dictionary."""
    own = detections.join(texts.select("unit_id", plain_label(F.col("label")).alias("__label")), "unit_id", "left").withColumn("__value", plain_label(F.col("value")))
    phrases = F.broadcast(labels.select(F.col("phrase").alias("__value")).distinct())  # the fixed dictionary
    return own.where("__label is null or __label <> __value").join(phrases, "__value", "left_anti").drop("__label", "__value")


def residual_label_fallback(bindings: DataFrame, detections: DataFrame) -> DataFrame:
    """(unit_id, category, span_start, span_end, confidence): labelled values that no detection overlaps; bindings: unit_id, category, span_start, span_end, and others that stay."""
    d = detections.select("unit_id", F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    b = bindings.alias("b")
    free = b.join(d.hint("merge"), (F.col("b.unit_id") == d.unit_id) & (F.col("b.span_start") < F.col("e")) & (F.col("s") < F.col("b.span_end")), "left_anti")
    return free.select(*bindings.columns, F.lit(0.65).alias("confidence"))


def detect_tags(parts: DataFrame) -> DataFrame:
    """(page_id, seq, category, confidence): parts that their site marks: a password, or something private."""
    marks = F.split("marks", ",")
    generic = F.arrays_overlap(marks, F.array(*map(F.lit, ("data-private", "data-pii", "data-hj-suppress", "data-clarity-mask", "rr-mask", "rr-block", "sentry-mask"))))
    category = F.when(F.array_contains(marks, "type-password"), "PASSWORD").when(generic, "PRIVATE_GENERIC")
    return parts.select("page_id", "seq", category.alias("category")).where("category is not null").withColumn("confidence", F.when(F.col("category") == "PASSWORD", 1.0).otherwise(0.5))
