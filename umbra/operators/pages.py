"""Pages as rows: text blocks, elements and media, and what is derived from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from umbra.sources.tables import stored

# Tags that make blocks, are skipped, act or show media; marks that sites put on private parts.
BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "listitem", "td": "cell", "th": "columnheader", "label": "label", "dt": "term", "dd": "definition", "figcaption": "caption", "caption": "caption", "blockquote": "quote", "legend": "legend"}
SKIPPED = ("script", "style", "template", "noscript")
ROLES = {"a": "link", "button": "button", "input": "textbox", "select": "combobox", "textarea": "textbox", "summary": "button"}
ARIA = ("button", "link", "checkbox", "radio", "switch", "tab", "menuitem", "option", "textbox", "searchbox", "combobox", "slider", "spinbutton")
MEDIA = {"img": "img", "canvas": "canvas", "video": "video", "embed": "embed", "object": "object", "iframe": "iframe"}
MARKS = ("data-private", "data-pii", "data-hj-suppress", "data-clarity-mask", "rr-mask", "rr-block", "sentry-mask")
#: What an opening tag closes first when it is still open.
CLOSES = {t: ("p",) for t in ("p", "ul", "ol", "dl", "div", "table", "section", "article", "header", "footer", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "form", "pre")} | {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
CONTAINERS = ("ul", "ol", "dl", "table", "tbody", "tr", "td", "th", "div", "section", "article", "li", "dd", "body")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

PARTS = "page_id long, kind string, seq int, tag string, role string, text string, attr string, hidden string, marks string, in_form boolean"
#: What else an element or label says: its id, the ids it is named by, the id it is for, type, autocomplete, address, own name, hint, and the label around it.
SAID = ("dom_id", "labelledby", "label_for", "input_type", "autocomplete", "href", "aria_label", "hint")
SAYING = PARTS + "".join(f", {name} string" for name in SAID) + ", around int"
#: So many pages are taken apart before their parts leave Python.
PAGES_A_BATCH = 64
#: Below so much of itself, all around it counted, a part isn't seen.
LEAST_OPACITY = 0.05


class _Page(HTMLParser):
    """One pass over a page; parts are [kind, seq, tag, role, texts, attr, hidden reason, marks, in a form, what else it says].

    Texts of tags with an id are kept by id too, for parts that are named by them. attr is an address, an autocomplete attribute or, of a block, where it stands: `t:table:row:column` or `f:fieldset`.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.stack: list[tuple[str, list | None, str | None, tuple[str, ...], float, list[str] | None]] = []
        self.by_id: dict[str, list[str]] = {}
        self.tables: list[list[int]] = []  # open tables: number, row, column
        self.fieldsets: list[int] = []
        self.n_tables = self.n_fieldsets = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        closes = CLOSES.get(tag, ())
        for i in range(len(self.stack) - 1, -1, -1) if closes else ():
            if self.stack[i][0] in closes:
                del self.stack[i:]
                break
            if self.stack[i][0] in CONTAINERS:
                break
        *_, hidden, marks, opacity, _ = self.stack[-1] if self.stack else (None, None, None, (), 1.0, None)
        if a:  # a tag without attributes is as hidden and marked as what is around it
            hidden, marks, opacity = self._inherited(tag, a, hidden, marks, opacity)
        if tag == "table":
            self.n_tables += 1
            self.tables.append([self.n_tables, 0, 0])
        elif tag == "fieldset":
            self.n_fieldsets += 1
            self.fieldsets.append(self.n_fieldsets)
        elif tag == "tr" and self.tables:
            self.tables[-1][1:] = [self.tables[-1][1] + 1, 0]
        elif tag in ("td", "th") and self.tables:
            self.tables[-1][2] += 1
        part, own_text = None, None
        if a.get("id") and a["id"] not in self.by_id:  # the first of an id is the one that is referred to
            own_text = self.by_id[a["id"]] = []
        usable = tag in ROLES and (tag != "a" or "href" in a) or bool(a) and (a.get("role") in ARIA or a.get("contenteditable") in ("", "true") or a.get("tabindex", "-1") != "-1")
        said = self._said(tag, a) if usable or tag in BLOCKS or tag in MEDIA else None
        if tag in BLOCKS:
            where = "t:" + ":".join(map(str, self.tables[-1])) if tag in ("td", "th") and self.tables else f"f:{self.fieldsets[-1]}" if self.fieldsets else ""
            part = self._add("block", tag, BLOCKS[tag], "", where, hidden, marks, said)
        if usable:
            own = self._add("element", tag, a.get("role") or ROLES.get(tag, "generic"), a.get("aria-label") or a.get("title") or a.get("placeholder") or "", a.get("href") or a.get("autocomplete") or "", hidden, marks, said)
            part = part or (own if tag not in ("input", "select", "textarea") and not own[4] else None)
        if tag in MEDIA:
            self._add("media", tag, MEDIA[tag], a.get("alt", ""), a.get("src", ""), hidden, marks, said)
        if tag not in VOID:
            self.stack.append((tag, part, hidden, marks, opacity, own_text))

    @staticmethod
    def _inherited(tag: str, a: dict[str, str], hidden: str | None, marks: tuple[str, ...], opacity: float) -> tuple[str | None, tuple[str, ...], float]:
        """Why a tag with attributes is hidden, its marks and its opacity, from those around it."""
        style = a.get("style", "").replace(" ", "").lower()
        set_to = re.search(r"(?:^|;)opacity:([0-9]*\.?[0-9]+)", style) if style else None
        opacity = opacity * (min(1.0, float(set_to[1])) if set_to else 1.0)
        reasons = [("aria-hidden", a.get("aria-hidden") == "true"), ("inert", "inert" in a), ("display", "display:none" in style), ("visibility", "visibility:hidden" in style), ("opacity", opacity < LEAST_OPACITY)]
        hidden = hidden or next((name for name, on in reasons if on), None)
        marks = tuple(dict.fromkeys([*marks, *(m for m in MARKS if m in a), *(["autocomplete-cc"] if a.get("autocomplete", "").lower().startswith("cc-") else []), *(["type-password"] if tag == "input" and a.get("type", "").lower() == "password" else [])]))
        return hidden, marks, opacity

    def _said(self, tag: str, a: dict[str, str]) -> tuple:
        """What a part says of itself besides its text, and the label around it."""
        kind = a.get("type", "").lower() or ("text" if tag == "input" else "")
        around = next((p[1] for t, p, *_ in reversed(self.stack) if t == "label" and p and p[0] == "block"), None)
        return (a.get("id"), a.get("aria-labelledby"), a.get("for") if tag == "label" else None, kind or None, a.get("autocomplete"), a.get("href"), a.get("aria-label"), a.get("title") or a.get("placeholder"), around)

    def _add(self, kind: str, *rest) -> list:
        self.parts.append([kind, len(self.parts), *rest[:2], [rest[2]] if rest[2] else [], rest[3], rest[4], ",".join(rest[5]), any(t == "form" for t, *_ in self.stack), rest[6]])
        return self.parts[-1]

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.stack):
            gone = None
            while gone != tag:
                gone = self.stack.pop()[0]
                for name, open_ in (("table", self.tables), ("fieldset", self.fieldsets)):
                    if gone == name and open_:
                        open_.pop()

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if not text or any(t in SKIPPED for t, *_ in self.stack):
            return
        for *_, named in self.stack:
            if named is not None:
                named.append(text)
        near = [part for _, part, *_ in reversed(self.stack[-7:]) if part]
        for part in near[:1] + [p for p in near[1:2] if near[0][0] == "element" and p[0] == "block"]:
            part[4].append(text)


def page_parts(pages: DataFrame) -> DataFrame:
    """(page_id, kind, seq, tag, role, text, attr, hidden, marks, in_form): blocks, elements and media of each page in order.

    Each page is read once; one without an id has parts without one. Text is that of the nearest block (six levels up at most), nodes joined by one space;
    hidden is the first reason that holds for the part or what is around it.
    """
    return _read(pages, PARTS)


def saying_parts(pages: DataFrame) -> DataFrame:
    """The parts of pages with what else they say, and a row of kind `target` with the text of each id that a part is named by."""
    return _read(pages, SAYING)


def _read(pages: DataFrame, columns: str) -> DataFrame:
    """Parts of pages, PAGES_A_BATCH pages at a time, so that a task holds few of them whatever their number."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])
    saying = columns == SAYING

    def rows(page_id: int | None, html: str | None) -> Iterator[tuple]:
        page = _Page()
        page.feed(html or "")
        page.close()
        for k, s, t, r, x, at, h, m, f, said in page.parts:
            part = (page_id, k, s, t, r, " ".join(x), at, h, m, f)
            yield (*part, *said) if saying else part
        if saying:
            asked = sorted({name for *_, said in page.parts for name in (said[1] or "").split()} & set(page.by_id))
            for name in asked:
                yield (page_id, "target", None, None, None, " ".join(page.by_id[name]), None, None, None, None, name, *[None] * 8)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES_A_BATCH):
                few = batch.slice(first, PAGES_A_BATCH)
                made = [row for page_id, html in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True) for row in rows(page_id, html)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(read, columns)


def named_elements(parts: DataFrame) -> DataFrame:
    """(page_id, seq, tag, role, name, label_text, input_type, autocomplete, href, hidden, in_form): elements with their accessible names.

    parts: those of saying_parts. A name is the text of the ids that the element is labelled by, in their order; else its
    aria-label; else its label, one for its id or around it; else its own text; else its title or placeholder. label_text is
    the label alone. References are resolved within a page; ids that nothing has count for nothing, and of several labels the first counts.
    """
    page = F.coalesce("page_id", F.lit(-1)).alias("__page")  # pages without an id are one to themselves
    parts = stored(parts)  # pages are read once for all that is made of their parts
    rows = parts.where("kind = 'element'").withColumn("__page", page)
    targets = parts.where("kind = 'target'").select(page, F.col("dom_id").alias("__id"), F.col("text").alias("__text"))
    asked = rows.where("labelledby is not null").select("__page", "seq", F.posexplode(F.split(F.trim("labelledby"), r"\s+")).alias("__at", "__id")).join(targets.hint("merge"), ["__page", "__id"])
    texts = F.array_sort(F.collect_list(F.struct("__at", "__text")))
    by_ids = asked.groupBy("__page", "seq").agg(F.array_join(F.filter(F.transform(texts, lambda x: x["__text"]), lambda t: t != ""), " ").alias("__by"))
    labels = parts.where("kind = 'block' and tag = 'label' and text <> ''").select(page, F.col("seq").alias("__seq"), "label_for", F.col("text").alias("__label"))
    first = labels.where("label_for is not null").groupBy("__page", F.col("label_for").alias("dom_id")).agg(F.min_by("__label", "__seq").alias("__for"))
    wrapping = labels.select("__page", F.col("__seq").alias("around"), F.col("__label").alias("__around"))
    joined = rows.join(by_ids.hint("merge"), ["__page", "seq"], "left").join(first.hint("merge"), ["__page", "dom_id"], "left").join(wrapping.hint("merge"), ["__page", "around"], "left")
    label = F.coalesce("__for", "__around")
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    own = F.when(~F.col("tag").isin("input", "select", "textarea") & F.col("aria_label").isNull() & F.col("hint").isNull(), F.col("text"))
    name = F.coalesce(filled(F.col("__by")), filled(F.col("aria_label")), filled(label), filled(own), filled(F.col("hint")), F.lit(""))
    return joined.select("page_id", "seq", "tag", "role", name.alias("name"), F.coalesce(label, F.lit("")).alias("label_text"), "input_type", "autocomplete", "href", "hidden", "in_form")


def text_blocks(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'block' and text <> ''").select("page_id", "seq", "tag", "role", "text", "attr", "hidden", "marks")


def elements(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'element'").select("page_id", "seq", "tag", "role", F.col("text").alias("name"), "attr", "hidden", "marks", "in_form")


def media(parts: DataFrame) -> DataFrame:
    """(page_id, seq, kind, alt, filename, hidden)"""
    name = F.regexp_extract(F.regexp_replace("attr", "[?#].*$", ""), "[^/]*$", 0)
    return parts.where("kind = 'media'").select("page_id", "seq", F.col("role").alias("kind"), F.col("text").alias("alt"), name.alias("filename"), "hidden")


def structural_context(blocks: DataFrame) -> DataFrame:
    """blocks with the heading that they stand under, the legend of their fieldset and the header of their column."""
    before = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role, w: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(w)
    at = F.split("attr", ":")
    placed = blocks.withColumns({"__group": F.when(F.col("attr").startswith("t:"), F.concat_ws(":", F.lit("t"), at[1], at[3])).otherwise(F.col("attr")), "heading": last("heading", before)})
    near = Window.partitionBy("page_id", "__group").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda kind, role: F.when(F.col("attr").startswith(kind), last(role, near))
    return placed.withColumns({"legend": inside("f:", "legend"), "column_header": F.when(F.col("role") == "cell", inside("t:", "columnheader"))}).drop("__group")


def row_fingerprint(rows: DataFrame, salt: str, key: str = "page_id") -> DataFrame:
    """rows with fp, a salted key of role, tag and name (digits as #), and ordinal, the how-manieth of its page."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce("name", F.lit("")))), "[0-9]+", "#")
    fp = F.substring(F.sha2(F.concat_ws("\x01", F.lit(salt), "role", "tag", name), 256), 1, 8)
    return rows.withColumn("fp", fp).withColumn("ordinal", F.row_number().over(Window.partitionBy(key, "fp").orderBy("seq")) - 1)


def stable_ids(before: DataFrame, now: DataFrame) -> DataFrame:
    """(page_id, fp, ordinal, eid, ambiguous): ids of `before` stay where the element is still there; others get the next numbers
    of their page. Elements that share a fingerprint with another of their page are ambiguous."""
    top = before.groupBy("page_id").agg(F.max("eid").alias("top"))
    joined = now.select("page_id", "fp", "ordinal").join(before.select("page_id", "fp", "ordinal", "eid"), ["page_id", "fp", "ordinal"], "left").join(top, "page_id", "left")
    fresh = F.row_number().over(Window.partitionBy("page_id", F.col("eid").isNull()).orderBy("fp", "ordinal"))
    return joined.withColumn("eid", F.coalesce("eid", F.coalesce("top", F.lit(0)) + fresh)).withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy("page_id", "fp")) > 1).select("page_id", "fp", "ordinal", "eid", "ambiguous")


def nearest_label(values: DataFrame, labels: DataFrame, most: int = 120) -> DataFrame:
    """(page_id, value_id, label_id): the nearest label of a value's page left on the same row or above in the same column, within `most`.

    Boxes meet by grid cells of that size, a label in its own and the neighbouring cells, so no pair further apart is made.
    """
    cell = lambda c: F.floor(F.col(c) / most)
    v = values.select("page_id", "value_id", F.col("x").alias("vx"), F.col("y").alias("vy"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    lab = labels.select("page_id", "label_id", F.col("x").alias("lx"), F.col("y").alias("ly"), cell("x").alias("gx"), cell("y").alias("gy"), F.inline(around))
    lab = lab.select("page_id", "label_id", "lx", "ly", (F.col("gx") + F.col("dx")).alias("cx"), (F.col("gy") + F.col("dy")).alias("cy"))
    left = (F.col("ly") == F.col("vy")) & (F.col("lx") < F.col("vx"))
    above = (F.col("lx") == F.col("vx")) & (F.col("ly") < F.col("vy"))
    far = (F.col("vx") - F.col("lx")) ** 2 + (F.col("vy") - F.col("ly")) ** 2
    return v.join(lab, ["page_id", "cx", "cy"]).where((left | above) & (far <= most * most)).groupBy("page_id", "value_id").agg(F.min_by("label_id", F.struct(far, "label_id")).alias("label_id"))


def frame_paths(frames: DataFrame) -> DataFrame:
    """(frame_id, path): ids from the root to each frame, however deep; frames in or below a cycle have none."""
    placed = frames.select("frame_id", "parent_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return frame_offsets(placed).select("frame_id", "path")


def frame_offsets(frames: DataFrame) -> DataFrame:
    """(frame_id, path, dx, dy): ids from the root to each frame, and where its corner is on the root; frames: frame_id, parent_id, x, y in the parent.

    By pointer jumping: in each round a frame's path and offset are put behind those of the ancestor it begins at, so the rounds
    are the logarithm of the depth; what is settled leaves, and what doesn't reach a root in the end is a cycle. A root
    stands where its own x and y say; a frame whose parent isn't there reaches none. Null places count as 0.
    """
    of = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    now, before = stored(frames.select("frame_id", F.col("parent_id").alias("up"), F.array(F.col("frame_id")).alias("ids"), of("x").alias("dx"), of("y").alias("dy"))), None
    while (left := now.where("up is not null").count()) and left != before:
        above = now.select(F.col("frame_id").alias("__up"), F.col("up").alias("__next"), F.col("ids").alias("__ids"), F.col("dx").alias("__dx"), F.col("dy").alias("__dy"))
        joined = now.join(above, F.col("up") == F.col("__up"), "left")
        known = F.col("__ids").isNotNull()
        jumped = joined.select(
            "frame_id", F.when(known, F.col("__next")).otherwise(F.col("up")).alias("up"), F.when(known, F.concat("__ids", "ids")).otherwise(F.col("ids")).alias("ids"),
            (F.col("dx") + F.coalesce("__dx", F.lit(0.0))).alias("dx"), (F.col("dy") + F.coalesce("__dy", F.lit(0.0))).alias("dy"),
        )
        now, before = stored(jumped.where("up is null or not array_contains(ids, up)")), left
    return now.where("up is null").select("frame_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), "/").alias("path"), "dx", "dy")


def page_boxes(boxes: DataFrame, offsets: DataFrame) -> DataFrame:
    """boxes (frame_id, x, y, w, h in their frame) with left and top on the root; those of frames that reach no root have none and are left out."""
    joined = boxes.join(offsets.select("frame_id", "dx", "dy"), "frame_id")
    return joined.withColumns({"left": F.col("x") + F.col("dx"), "top": F.col("y") + F.col("dy")}).drop("dx", "dy")


# The categories of fields that make a form one about a person.
IDENTITY_FIELDS = ("NAME", "EMAIL", "PHONE", "ADDRESS", "DOB", "AADHAAR", "PAN", "CARD_NUMBER", "BANK_ACCOUNT")


def page_type(fields: DataFrame) -> DataFrame:
    """(page_id, page_type): kyc_form, login, form or null by password fields and at least three identity fields; fields: page_id, input_type, category."""
    password = F.coalesce(F.bool_or(F.col("input_type") == "password"), F.lit(False))
    many = F.count_if(F.col("category").isin(*IDENTITY_FIELDS)) >= 3
    return fields.groupBy("page_id").agg(F.when(password & many, "kyc_form").when(password, "login").when(many, "form").alias("page_type"))


def safe_search_forms(fields: DataFrame) -> DataFrame:
    """(page_id, eid, safe): whether a search field may be submitted: it has no form, or its form stays at the origin and asks for nothing private.

    fields: page_id, eid, form, in_search, input_type, category, action_origin, origin.
    """
    private = (F.coalesce("input_type", F.lit("")) == "password") | F.col("category").isNotNull()
    forms = fields.where("form is not null").groupBy("page_id", "form").agg(F.bool_or(private).alias("__private"), F.max("action_origin").alias("__action"))
    joined = fields.where("in_search").join(forms, ["page_id", "form"], "left")
    away = F.coalesce(F.col("__action") != F.col("origin"), F.lit(False))
    return joined.select("page_id", "eid", F.when(F.col("form").isNull(), True).otherwise(~away & ~F.col("__private")).alias("safe"))


def fill_state(category: Column, value: Column) -> Column:
    """empty, partial or filled, by the expected length of the category's values."""
    # Least lengths of whole values.
    least = {"AADHAAR": 12, "PAN": 10, "CARD_NUMBER": 13, "IFSC": 11, "PHONE": 10, "PIN_CODE": 6, "VOTER_ID": 10, "PASSPORT": 8, "ABHA": 14, "UAN": 12}
    want = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), category)
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").when(F.length(F.regexp_replace(value, "[ -]", "")) < want, "partial").otherwise("filled")
