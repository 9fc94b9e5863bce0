"""Cut documents into blocks: plain-text paragraphs, Markdown structure, CSV records.

Each segmenter is a column expression from text to ``array<BLOCK>``. A document is one row, and
its size is limited at admission, so no line or block ever needs a shuffle: skewed corpora cost
nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.lets import computed_once, indexed, let
from askgrid.functions.text import is_blank, rstrip, strip, strip_line

BLOCK = (
    "struct<ordinal:int,kind:string,text:string,start_line:int,end_line:int,"
    "section_path:array<string>,page_number:int,heading_level:int,code_language:string>"
)


def _block(kind, text, start, end, path=None, level=None, language=None) -> list[Column]:
    """Fields of ``BLOCK`` after the ordinal."""
    return [
        kind.alias("kind"),
        text.alias("text"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        (F.array().cast("array<string>") if path is None else path).alias("section_path"),
        F.lit(None).cast("int").alias("page_number"),
        (F.lit(None).cast("int") if level is None else level).alias("heading_level"),
        (F.lit(None).cast("string") if language is None else language).alias("code_language"),
    ]


def _numbered(blocks: Column) -> Column:
    fields = ("kind", "text", "start_line", "end_line", "section_path", "page_number",
              "heading_level", "code_language")
    return F.transform(
        blocks,
        lambda b, i: F.struct(i.cast("int").alias("ordinal"), *[b[f].alias(f) for f in fields]),
    ).cast(f"array<{BLOCK}>")


# --- paragraphs -----------------------------------------------------------------------------

def paragraph_blocks(text: Column) -> Column:
    """Runs of non-blank lines; lines right-trimmed, blocks trimmed; 1-based line ranges."""

    def build(lines: Column, full: Column) -> Column:
        size = F.size(lines)
        numbers = F.sequence(F.lit(1), size)
        starts = F.filter(
            numbers,
            lambda i: F.element_at(full, i)
            & F.when(i == 1, F.lit(True)).otherwise(~F.get(full, i - 2)),
        )
        ends = F.filter(
            numbers,
            lambda i: F.element_at(full, i)
            & F.when(i == size, F.lit(True)).otherwise(~F.get(full, i)),
        )
        return F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(*_block(
                F.lit("paragraph"),
                strip(F.array_join(F.transform(F.slice(lines, s, e - s + 1), rstrip), "\n")),
                s, e,
            )),
        )

    return _numbered(
        let(
            F.split(text, "\n"),
            lambda lines: let(
                F.transform(lines, lambda line: ~is_blank(line)),
                lambda full: build(lines, full),
            ),
        )
    )


# --- Markdown -------------------------------------------------------------------------------

# Patterns on a line without its leading white space; how far it is indented is a number.
_ATX = r"^(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"
_ATX_LINE = r"^#{1,6}(?:[ \t]|$)"
_FENCE = r"^(`{3,}|~{3,})(.*)$"
_RULE = r"^([-*_])[ \t]*(?:\1[ \t]*){2,}$"
_UNDERLINE = r"^(?:=+|-+)[ \t]*$"
_ITEM = r"^(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)"
_QUOTE = r"^(?: {0,3}> ?)+"
# Cheap first test: only such lines can be anything but text.
_SPECIAL = r"^[#=*_+0-9`~-]"
_LINE = "struct<i:int,kind:string,new:boolean,text:string,info:string,listed:boolean>"
_SEEN = (f"struct<mark:string,fence_indent:int,fence_quoted:boolean,list_indent:int,prev:string,"
         f"last:string,quoted:boolean,line:{_LINE}>")
_FOLD = (f"struct<seen:{_SEEN},kept:struct<done:array<array<array<{_LINE}>>>,"
         f"recent:array<array<{_LINE}>>,block:array<array<{_LINE}>>,tail:array<{_LINE}>>>")
#: Folded lines are kept in batches, so that adding one never copies all before it.
FOLD_BATCH = 128

# The entities that are written out.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
             ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&amp;", "&"))


def inline_text(text: Column) -> Column:
    """Text without emphasis marks, code ticks, links, autolinks, entities and escapes."""
    return let(text, lambda raw: F.when(
        raw.rlike(r"[*_`\[\\<&]"), strip(_without_marks(raw))).otherwise(strip_line(raw)))


def _without_marks(text: Column) -> Column:
    for pattern, kept in (
        (r"`+([^`]+)`+", "$1"),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"<((?:https?|ftp|mailto):[^\s<>]*)>", "$1"),
        (r"(\*\*|(?<!\w)__)(?=\S)(.+?)(?<=\S)\1", "$2"),
        (r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?![\w*])", "$1"),
        (r"(?<![\w_])_(?=\S)([^_\n]+?)(?<=\S)_(?![\w_])", "$1"),
        (r"\\([!-/:-@\[-`{-~])", "$1"),
    ):
        text = F.regexp_replace(text, pattern, kept)
    for name, letter in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def _line_forms(lines: Column) -> Column:
    """What each line could be by itself: its indentation, quote marks and form."""

    def form(core: Column) -> Column:
        return (
            F.when(is_blank(core), "blank")
            .when(~core.rlike(_SPECIAL), "text")
            .when(core.rlike(_ATX_LINE), "heading")
            .when(core.rlike(_FENCE), "fence")
            .when(core.rlike(_UNDERLINE), "underline")
            .when(core.rlike(_RULE), "rule")
            .when(core.rlike(_ITEM), "item")
            .otherwise("text")
        )

    def facts(v: Column, i: Column, body: Column, quoted: Column) -> Column:
        core = F.ltrim(body, F.lit(" \t"))
        lead = F.regexp_extract(body, r"^[ \t]*", 0)
        indented = body.startswith(" ") | body.startswith("\t")
        # Only the form is bound by ``let``: what it binds is copied.
        return F.struct(
            i.cast("int").alias("i"), v.alias("v"), body.alias("body"), core.alias("core"),
            F.when(indented, F.length(F.replace(lead, F.lit("\t"), F.lit("    ")))).otherwise(0)
            .alias("indent"), quoted.alias("quoted"), let(core, form).alias("form"))

    def of(v: Column, i: Column) -> Column:
        quoted = F.ltrim(v).startswith(">") & v.rlike(r"^ {0,3}>")
        return F.when(quoted, let(F.regexp_replace(v, _QUOTE, ""), lambda body: facts(
            v, i, body, F.lit(True)))).otherwise(facts(v, i, v, F.lit(False)))

    return F.transform(lines, of)


def _gathered(acc: Column) -> Column:
    """``kept`` with the line last seen.

    A line goes to the tail of its block; a full tail joins the block, and a finished block the
    recent ones, so adding a line never copies all before it.
    """
    line, kept = acc["seen"]["line"], acc["kept"]
    some, fresh = line.isNotNull(), F.coalesce(line["new"], F.lit(False))
    one, closed = F.array(line), _closed(kept["block"], kept["tail"])
    long, full = F.size(kept["tail"]) >= FOLD_BATCH, F.size(kept["recent"]) >= FOLD_BATCH
    none = F.array().cast(f"array<array<{_LINE}>>")

    def of(done: Column, recent: Column, block: Column, tail: Column) -> Column:
        return F.struct(done.alias("done"), recent.alias("recent"), block.alias("block"),
                        tail.alias("tail"))

    done, recent, block, tail = (kept[name] for name in ("done", "recent", "block", "tail"))
    return (
        F.when(~some, kept)
        .when(~fresh & ~long, of(done, recent, block, F.array_append(tail, line)))
        .when(~fresh, of(done, recent, F.concat(block, F.array(tail)), one))
        .when(~full, of(done, F.array_append(recent, closed), none, one))
        .otherwise(of(F.concat(done, F.array(recent)), F.array(closed), none, one))
    )


def _closed(block: Column, tail: Column) -> Column:
    """The lines of a finished block; few have more than one batch."""
    return F.when(F.size(block) == 0, tail).otherwise(
        F.flatten(F.concat(block, F.array(tail))))


def _fold_line(acc: Column, x: Column) -> Column:
    """The line before goes to its block, and this one is seen.

    What is bound by ``let`` is copied, so only the small state is; what is gathered stays outside.
    """
    return F.struct(_see_line(acc["seen"], x).alias("seen"), _gathered(acc).alias("kept"))


def _see_line(acc: Column, x: Column) -> Column:
    """One line in the state before it: open fence, open list item, kind of the line above.

    Most lines are blank or plain text outside fences and lists: those need no rule of Markdown,
    and so few of the steps that the others take.
    """
    blank = x["form"] == "blank"
    plain = (acc["mark"] == "") & (blank | (
        (x["form"] == "text") & (acc["list_indent"] < 0) & ~x["quoted"] & (x["indent"] <= 3)))
    line = F.struct(
        x["i"].alias("i"), x["form"].alias("kind"),
        (~blank & ~acc["prev"].isin("text", "item")).alias("new"),
        F.when(blank, "").otherwise(strip_line(x["core"])).alias("text"),
        F.lit(None).cast("string").alias("info"), F.lit(False).alias("listed"))
    seen = F.struct(
        F.lit("").alias("mark"), acc["fence_indent"].alias("fence_indent"),
        acc["fence_quoted"].alias("fence_quoted"), acc["list_indent"].alias("list_indent"),
        x["form"].alias("prev"), F.when(blank, acc["last"]).otherwise("text").alias("last"),
        x["quoted"].alias("quoted"), line.alias("line"))
    return F.when(plain, seen).otherwise(_see_marked_line(acc, x))


def _see_marked_line(acc: Column, x: Column) -> Column:
    """``_see_line`` of any line."""
    run = F.when(x["form"] == "fence", F.regexp_extract(x["core"], _FENCE, 1)).otherwise("")
    rest = F.when(x["form"] == "fence", strip(F.regexp_extract(x["core"], _FENCE, 2))).otherwise("")
    fenced = (acc["mark"] != "") & (~acc["fence_quoted"] | x["quoted"])
    closes = (
        fenced & (x["form"] == "fence") & (F.length(run) >= F.length(acc["mark"]))
        & (F.substring(run, 1, 1) == F.substring(acc["mark"], 1, 1)) & (rest == ""))
    blank, prev = x["form"] == "blank", acc["prev"]
    open_text = prev.isin("text", "item")
    listing = acc["list_indent"] >= 0
    # A line left of an item's content ends the list, unless it continues a paragraph.
    outside = listing & ~blank & (x["indent"] < acc["list_indent"]) & (x["form"] != "item")
    leaves = outside & (~open_text | x["form"].isin("heading", "fence", "rule", "underline")
                        | (x["quoted"] & ~acc["quoted"]))
    base = F.when(listing & (x["indent"] >= acc["list_indent"]), acc["list_indent"]).otherwise(0)
    near = (x["indent"] - base) <= 3
    same = x["quoted"] == acc["quoted"]
    # An ordered item interrupts a paragraph only if it is number one.
    item = (x["form"] == "item") & (near | listing) & ~(
        (prev == "text") & ~listing & x["core"].rlike(r"^\d") & ~x["core"].rlike(r"^1[.)]"))
    opens = (x["form"] == "fence") & near & ~(run.startswith("`") & rest.contains("`"))
    kind = (
        F.when(closes, "close").when(fenced, "fence").when(blank, "blank")
        .when(~near & ~open_text & ~(item & listing), "code")
        .when((x["form"] == "heading") & near, "heading")
        .when(opens, "open")
        .when((x["form"] == "underline") & near & (prev == "text") & same & ~outside, "setext")
        .when(x["form"].isin("rule", "underline") & near & x["core"].rlike(_RULE), "rule")
        .when(item, "item")
        .otherwise("text")
    )

    def built(k: Column) -> Column:
        fresh = (
            k.isin("heading", "open", "item")
            | ((k == "code") & (acc["last"] != "code"))
            | ((k == "text") & (~open_text | (x["quoted"] & ~acc["quoted"])))
        )
        raw = F.when(acc["fence_quoted"], x["body"]).otherwise(x["v"])
        text = (
            F.when(k == "fence", F.regexp_replace(raw, F.concat(
                F.lit("^ {0,"), acc["fence_indent"].cast("string"), F.lit("}")), F.lit("")))
            .when(k == "code", F.substring(x["body"], base + 5, F.length(x["body"])))
            .when(k == "item", F.regexp_replace(x["core"], _ITEM, ""))
            .when(k.isin("blank", "rule", "close", "open"), "")
            .otherwise(strip_line(x["core"]))
        )
        width = F.length(F.regexp_extract(x["core"], _ITEM, 0))
        line = F.struct(
            x["i"].alias("i"), k.alias("kind"), fresh.alias("new"), text.alias("text"),
            F.when(k == "open", rest).otherwise(F.when(k == "setext", x["core"])).alias("info"),
            ((k == "item") | (listing & ~leaves & (k == "text"))).alias("listed"))
        return F.struct(
            F.when(k == "open", run).when(k == "fence", acc["mark"]).otherwise("").alias("mark"),
            F.when(k == "open", x["indent"]).otherwise(acc["fence_indent"]).alias("fence_indent"),
            F.when(k == "open", x["quoted"]).otherwise(acc["fence_quoted"]).alias("fence_quoted"),
            F.when(k == "item", x["indent"] + width)
            .when(leaves & ~k.isin("fence", "close"), -1).otherwise(acc["list_indent"])
            .alias("list_indent"),
            k.alias("prev"),
            F.when(k == "blank", acc["last"]).otherwise(k).alias("last"),
            x["quoted"].alias("quoted"),
            line.alias("line"),
        )

    return let(kind, built)


def _line_groups(lines: Column) -> Column:
    """``array<array<_LINE>>``: the lines of each block; what stands before the first is one too."""
    seen = F.struct(
        F.lit("").alias("mark"), F.lit(0).alias("fence_indent"), F.lit(False).alias("fence_quoted"),
        F.lit(-1).alias("list_indent"), F.lit("blank").alias("prev"), F.lit("blank").alias("last"),
        F.lit(False).alias("quoted"), F.lit(None).alias("line"))
    start = F.struct(
        seen.alias("seen"), F.struct(
            F.array().alias("done"), F.array().alias("recent"), F.array().alias("block"),
            F.array().alias("tail")).alias("kept")).cast(_FOLD)

    def finish(acc: Column) -> Column:
        return let(_gathered(acc), lambda kept: F.concat(
            F.flatten(kept["done"]), kept["recent"],
            F.array(_closed(kept["block"], kept["tail"]))))

    return F.aggregate(_line_forms(lines), start, _fold_line, finish)


def _markdown_raw(groups: Column) -> Column:
    """Blocks without section paths, in line order, empty ones dropped."""

    def make(part: Column, end: Column) -> Column:
        # A line under a heading is always the last of its block.
        first, last = F.get(part, F.lit(0)), end["i"]
        under = F.when(end["kind"] == "setext", end["info"])
        fence, code = first["kind"] == "open", first["kind"] == "code"
        wanted = F.filter(part, lambda x: F.when(fence, x["kind"] == "fence").when(
            code, x["i"] <= last).otherwise(x["kind"].isin("text", "item", "heading")))
        joined = F.array_join(F.transform(wanted, lambda x: x["text"]), "\n")
        heading = first["kind"] == "heading"
        text = (
            F.when(fence | code, strip(joined))
            .when(heading, inline_text(F.regexp_extract(first["text"], _ATX, 2)))
            .otherwise(inline_text(joined))
        )
        kind = (
            F.when(fence | code, "code_block")
            .when(heading | under.isNotNull(), "heading")
            .when(first["listed"], "list_item")
            .otherwise("paragraph")
        )
        level = F.when(heading, F.length(F.regexp_extract(first["text"], _ATX, 1))).when(
            under.isNotNull(), F.when(under.startswith("="), 1).otherwise(2))
        language = F.when(fence, F.nullif(F.regexp_extract(first["info"], r"^\S+", 0), F.lit("")))
        return F.struct(*_block(kind, text, first["i"] + 1, last + 1, level=level,
                                language=language))

    def end(part: Column) -> Column:
        """The last line with content, found once per block and not again for each of its lines."""
        return F.element_at(F.filter(part, lambda x: ~x["kind"].isin("blank", "rule")), -1)

    real = F.filter(groups, lambda part: F.coalesce(F.get(part, F.lit(0))["new"], F.lit(False)))
    return F.filter(
        F.transform(real, lambda part: let(end(part), lambda last: make(part, last))),
        lambda b: F.length(b["text"]) > 0)


_HEADS = "struct<stack:array<struct<level:int,text:string>>,path:array<string>,any:boolean>"
_STACK = f"struct<heads:{_HEADS},done:array<array<array<string>>>,recent:array<array<string>>>"


def _with_paths(blocks: Column) -> Column:
    """Give every block the texts of the open headings above it, itself included."""

    def gathered(acc: Column) -> tuple[Column, Column]:
        heads, full = acc["heads"], F.size(acc["recent"]) >= FOLD_BATCH
        return (
            F.when(heads["any"] & full, F.concat(acc["done"], F.array(acc["recent"]))).otherwise(
                acc["done"]),
            F.when(~heads["any"], acc["recent"]).when(full, F.array(heads["path"])).otherwise(
                F.array_append(acc["recent"], heads["path"])),
        )

    def push(acc: Column, block: Column) -> Column:
        level, heading, heads = block["heading_level"], block["kind"] == "heading", acc["heads"]
        grown = F.concat(F.filter(heads["stack"], lambda x: x["level"] < level), F.array(
            F.struct(level.alias("level"), block["text"].alias("text"))))
        after = F.when(heading, let(grown, lambda stack: F.struct(
            stack.alias("stack"), F.transform(stack, lambda x: x["text"]).alias("path"),
            F.lit(True).alias("any")))).otherwise(F.struct(
                heads["stack"].alias("stack"), heads["path"].alias("path"),
                F.lit(True).alias("any")))
        done, recent = gathered(acc)
        return F.struct(after.alias("heads"), done.alias("done"), recent.alias("recent"))

    def finish(acc: Column) -> Column:
        done, recent = gathered(acc)
        return F.concat(F.flatten(done), recent)

    empty = F.struct(
        F.struct(F.array().alias("stack"), F.array().alias("path"), F.lit(False).alias("any"))
        .alias("heads"), F.array().alias("done"), F.array().alias("recent")).cast(_STACK)
    paths = F.aggregate(blocks, empty, push, finish)
    return F.zip_with(blocks, paths, lambda b, path: F.struct(*_block(
        b["kind"], b["text"], b["start_line"], b["end_line"], path, b["heading_level"],
        b["code_language"])))


def markdown_blocks(text: Column) -> Column:
    """Headings (# and underlined), paragraphs, list items and code with section paths.

    Block quotes are read through: their inner blocks count as if they stood alone. Paragraphs
    inside a list item are list items; code is fenced or indented. Work grows with the number of
    lines: one fold classifies them, with what came before it in batches.
    """
    # Only what is read twice is bound: each ``let`` copies the blocks once more.
    return _numbered(let(_markdown_raw(_line_groups(F.split(text, "\n"))), _with_paths))


# --- CSV ------------------------------------------------------------------------------------

MAX_CSV_ROWS = 10_000
MAX_CSV_COLUMNS = 200
# Section name of CSV records and name of a column without header.
CSV_SECTION = "CSV 记录"
CSV_COLUMN = "列 "
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^,"\n][^,\n]*+)'
_RECORD = rf"(?:{_FIELD})?(?:,(?:{_FIELD})?)*+(?:\n|\z)"
CSV_PARSED = f"struct<blocks:array<{BLOCK}>,code:string>"


def _csv_values(record: Column) -> Column:
    """Trimmed values of one record, quotes undone."""
    raw = F.regexp_extract_all(
        F.concat(F.lit(","), F.regexp_replace(record, r"\n\z", "")), F.lit(rf",(?:{_FIELD})?"),
        F.lit(0),
    )
    return F.transform(
        raw,
        lambda v: strip(
            F.when(F.substring(v, 2, 1) == '"',
                   F.replace(F.regexp_replace(v, r'^,"|"\z', ""), F.lit('""'), F.lit('"')))
            .otherwise(F.substring(v, F.lit(2), F.length(v)))
        ),
    )


def csv_headers(values: Column) -> Column:
    """Unique column names: empty ones numbered, repeats suffixed with their count."""
    bases = F.transform(
        values,
        lambda v, i: F.when(v == "", F.concat(F.lit(CSV_COLUMN), (i + 1).cast("string")))
        .otherwise(v),
    )

    def numbered(sorted_: Column) -> Column:
        # Equal names stand together; the place within them is how often one was seen.
        firsts = F.filter(indexed(sorted_), lambda x: (x["i"] == 0) | (
            F.get(sorted_, x["i"] - 1)["base"] != x["v"]["base"]))
        return F.flatten(let(firsts, lambda runs: F.transform(runs, lambda run, k: F.transform(
            F.slice(sorted_, run["i"] + 1,
                    F.coalesce(F.get(runs, k + 1)["i"], F.size(sorted_)) - run["i"]),
            lambda x, n: F.struct(x["i"].alias("i"), F.when(n > 0, F.concat(
                x["base"], F.lit(" ("), (n + 1).cast("string"), F.lit(")"))
            ).otherwise(x["base"]).alias("name"))))))

    placed = F.array_sort(F.transform(
        bases, lambda base, i: F.struct(base.alias("base"), i.alias("i"))))
    return F.transform(F.array_sort(let(placed, numbered)), lambda x: x["name"])


def csv_parse(text: Column, max_rows: int = MAX_CSV_ROWS, max_columns: int = MAX_CSV_COLUMNS,
              max_chars: int = 5_000_000) -> Column:
    """``struct<blocks, code>``: one ``header: value`` block per record, or a reject code.

    The first record with a value is the header. Records of blanks are skipped; a record of
    another width, a broken quote, or exceeding a limit rejects the document.
    """
    records = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: r != "")

    def total(items: Column, measure) -> Column:
        return F.aggregate(items, F.lit(0), lambda acc, x: acc + measure(x))

    def line_ends(parts: Column) -> Column:
        """1-based last line of each record."""
        breaks = F.transform(
            parts, lambda r: F.length(F.regexp_replace(r, r"[^\n]", ""))
            + F.when(r.endswith("\n"), 0).otherwise(1)
        )
        ends = "struct<n:int,done:array<array<int>>,recent:array<int>>"

        def add(acc: Column, b: Column) -> Column:
            full, end = F.size(acc["recent"]) >= FOLD_BATCH, acc["n"] + b
            return F.struct(
                end.alias("n"),
                F.when(full, F.concat(acc["done"], F.array(acc["recent"]))).otherwise(
                    acc["done"]).alias("done"),
                F.when(full, F.array(end)).otherwise(F.concat(acc["recent"], F.array(end)))
                .alias("recent"))

        folded = F.aggregate(
            breaks,
            F.struct(F.lit(0).alias("n"), F.array().alias("done"), F.array().alias("recent"))
            .cast(ends),
            add,
            lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["recent"]))),
        )
        plain = F.sequence(F.lit(1), F.size(parts))
        return F.when(F.contains(text, F.lit('"')), folded).otherwise(plain)

    def build(parts: Column, ends: Column) -> Column:
        rows = F.filter(
            F.transform(
                parts,
                lambda r, i: F.struct(
                    _csv_values(r).alias("values"),
                    F.when(i == 0, 1).otherwise(F.get(ends, i - 1) + 1).alias("first"),
                    F.get(ends, i).alias("last"),
                ),
            ),
            lambda row: F.exists(row["values"], lambda v: v != ""),
        )
        return let(rows, from_rows)

    def from_rows(rows: Column) -> Column:
        # Too many columns are refused before their names are made.
        names = F.get(rows, F.lit(0))["values"]
        heads = F.when(F.size(names) > max_columns, names).otherwise(csv_headers(names))
        return let(heads, lambda h: finish(rows, h))

    def finish(rows: Column, heads: Column) -> Column:
        data = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        width = F.size(heads)
        blocks = F.transform(
            data,
            lambda row: F.struct(*_block(
                F.lit("paragraph"),
                F.array_join(F.zip_with(heads, row["values"], lambda h, v: F.concat(
                    h, F.lit(": "), v)), "\n"),
                row["first"], row["last"], F.array(F.lit(CSV_SECTION)))),
        )
        code = (
            F.when(width > max_columns, "resource_limit_exceeded")
            # The first offending record decides: one of another width, or one row too many.
            .when(F.exists(F.slice(data, 1, max_rows), lambda row: F.size(row["values"]) != width),
                  "malformed_document")
            .when(F.size(data) > max_rows, "resource_limit_exceeded")
        )
        return let(
            F.when(code.isNull(), blocks),
            lambda built: F.struct(
                _numbered(built).alias("blocks"),
                F.coalesce(
                    code,
                    F.when(total(built, lambda b: F.length(b["text"])) > max_chars,
                           "resource_limit_exceeded"),
                    F.when(F.size(built) == 0, "empty_content"),
                ).alias("code"),
            ),
        )

    def checked(parts: Column) -> Column:
        def failed(code: str) -> Column:
            return F.struct(F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"),
                            F.lit(code).alias("code")).cast(CSV_PARSED)

        whole = total(parts, lambda r: F.length(r)) == F.length(text)
        inked = F.exists(parts, lambda r: F.exists(_csv_values(r), lambda v: v != ""))
        return (
            F.when(~whole, failed("malformed_document"))
            .when(~inked, failed("empty_content"))
            .otherwise(let(line_ends(parts), lambda ends: build(parts, ends)).cast(CSV_PARSED))
        )

    return let(records, checked)


# --- frames ---------------------------------------------------------------------------------

def _explode_blocks(df: DataFrame, blocks: Column, key: str) -> DataFrame:
    return df.select(key, F.explode(blocks).alias("b")).select(key, "b.*")


def segment_paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _explode_blocks(df, paragraph_blocks(F.col(text)), key)


def segment_markdown(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _explode_blocks(df, markdown_blocks(F.col(text)), key)


def segment_csv(df: DataFrame, key: str = "doc_id", text: str = "text", **limits: int
                ) -> tuple[DataFrame, DataFrame]:
    """``(blocks, rejects)``."""
    parsed = computed_once(
        df.select(key, text), {"_p": csv_parse(F.col(text), **limits)}
    ).select(key, "_p.*")
    blocks = _explode_blocks(parsed.where("code is null"), F.col("blocks"), key)
    rejects = parsed.where("code is not null").select(key, F.col("code").alias("reject_code"))
    return blocks, rejects


def with_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``blocks`` and ``parse_code`` by ``document_format``, one row per document."""
    fmt = F.col("document_format")
    none = F.lit(None).cast(f"array<{BLOCK}>")
    parsed = F.when(fmt == "csv", csv_parse(F.col(text))).otherwise(
        F.struct(
            F.when(fmt == "plain_text", paragraph_blocks(F.col(text)))
            .when(fmt == "markdown", markdown_blocks(F.col(text)))
            .otherwise(none).alias("blocks"),
            F.lit(None).cast("string").alias("code"),
        ).cast(CSV_PARSED)
    )
    out = computed_once(df, {"_p": parsed})
    code = F.coalesce(
        F.col("_p.code"),
        F.when(F.col("_p.blocks").isNull(), "unsupported_type").when(
            F.size("_p.blocks") == 0, "empty_content"),
    )
    return out.withColumns({"blocks": F.col("_p.blocks"), "parse_code": code}).drop("_p")
