"""String, list and name helpers as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_delimited(value: Column, delimiter: str = ";") -> Column:
    """Split, trim, drop blanks; null gives an empty array."""
    parts = F.split(F.coalesce(value, F.lit("")), re.escape(delimiter))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def list_delimiter(region: Column, comma_regions: tuple[str, ...] = ("PassiveLists", "SkillLists")) -> Column:
    """Comma for two kinds of lists, else semicolon."""
    return F.when(region.isin(*comma_regions), ",").otherwise(";")


def sanitize_id(value: Column) -> Column:
    """Anything but ASCII letters, digits and _ becomes _."""
    return F.regexp_replace(value, "[^A-Za-z0-9_]", "_")


def strip_prefix_ci(value: Column, prefix: str) -> Column:
    """The rest after a prefix in any case, else null."""
    n = len(prefix)
    return F.when(F.lower(F.substring(value, 1, n)) == prefix.lower(), F.substring(value, n + 1, 2**31 - 1))


def capitalize_first(value: Column) -> Column:
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 2**31 - 1))


def singularize(value: Column) -> Column:
    """Drop one trailing s of a name longer than that."""
    return F.when(F.length(value) > 1, F.regexp_replace(value, "s$", "")).otherwise(value)


#: The entities, in the order in which decoding replaces them.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&apos;", "'"), ("&quot;", '"'))


def decode_entities(value: Column) -> Column:
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def escape_xml(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def substitute_captures(template: Column, text: Column, pattern: str) -> Column:
    """$1..$9 of the template by the groups of the pattern's first match."""
    for k in range(min(9, re.compile(pattern).groups), 0, -1):
        template = F.replace(template, F.lit(f"${k}"), F.regexp_extract(text, pattern, k))
    return template


def glob_regex(pattern: str) -> str:
    """An anchored case-insensitive pattern: * within a folder, ** across folders, ? one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"(?i)^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def data_pattern(roots: Sequence[str], extensions: Sequence[str]) -> str:
    """Pattern of the paths that a reference build reads: files of these types below a root or a dice set, and manifests."""
    escape = lambda s: re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)
    file = rf".+\.({'|'.join(extensions)})$"
    return rf"(({'|'.join(escape(r) for r in roots)})/{file}|Public/DiceSet_[^/]+/{file}|Mods/[^/]+/meta\.(lsx|lsf))"


def split_outside_parens(value: Column, delimiter: str = ";") -> Column:
    """Split at delimiters outside one level of parentheses; trimmed, blanks dropped."""
    d = re.escape(delimiter)
    parts = F.regexp_extract_all(value, F.lit(rf"((?:[^{d}()]|\([^()]*\))+)"), 1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def parse_selectors(value: Column) -> Column:
    """``Fn(a,b);...`` as an array of (name, params)."""
    def one(x: Column) -> Column:
        inner = F.regexp_extract(x, r"^\s*\w+\s*\(([^()]*)\)", 1)
        return F.struct(F.regexp_extract(x, r"^\s*(\w+)\s*\(", 1).alias("name"), F.transform(F.split(inner, ","), lambda p: F.trim(p)).alias("params"))

    return F.transform(F.filter(split_outside_parens(value), lambda x: x.rlike(r"^\s*\w+\s*\(")), one)


def selector_text(name: Column, params: Column) -> Column:
    """The inverse for one selector."""
    return F.concat(name, F.lit("("), F.array_join(params, ","), F.lit(")"))


def module_of(path: Column) -> Column:
    """The segment after Public, else after English itself, else the first segment, else Unknown."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "Public")
    after = F.when((at > 0) & (at < F.size(parts)), F.element_at(parts, F.greatest(at + 1, F.lit(1)).cast("int")))
    english = F.when(F.array_contains(parts, "English"), F.lit("English"))
    return F.coalesce(after, english, F.nullif(F.element_at(parts, 1), F.lit("")), F.lit("Unknown"))


def file_kind(path: Column) -> Column:
    """Extension to kind, null when not ingested."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.(lsx|lsf)$"), "lsx").when(p.rlike(r"/stats/.*\.txt$"), "stats").when(p.rlike(r"\.loca(\.xml)?$|/localization/.*\.xml$"), "loca").when(p.rlike(r"\.(xcd|xmd)$"), "allspark").when(p.rlike(r"\.(lsfx|lsefx)$"), "effect")


def content_handle() -> Column:
    """A new random handle."""
    return F.concat(F.lit("h"), F.replace(F.uuid(), F.lit("-"), F.lit("g")))


def is_content_handle(value: Column) -> Column:
    return value.rlike("^h[0-9a-f]{8}g[0-9a-f]{4}g[0-9a-f]{4}g[0-9a-f]{4}g[0-9a-f]{12}(;[0-9]+)?$")


def handle_version(value: Column) -> Column:
    """``handle;version`` as a struct, null for anything else."""
    return F.when(is_content_handle(value), F.struct(F.substring_index(value, ";", 1).alias("handle"), F.coalesce(F.regexp_extract(value, ";([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("version")))


def is_guid(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def markdown_plain(value: Column) -> Column:
    """Markdown without its marks."""
    for pattern, by in ((r"(?s)```.*?```", ""), (r"`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^>\s?", ""), (r"\n{3,}", "\n\n")):
        value = F.regexp_replace(value, pattern, by)
    return F.trim(value)


#: Sizes of headings by their marks, and marks of emphasis with their tags, longest first.
_HEADINGS = (("#{1,2}", 5), ("#{3}", 4), ("#{4,6}", 3))
_EMPHASIS = ((r"\*\*\*", ("b", "i")), (r"\*\*", ("b",)), (r"\*", ("i",)), ("~~", ("s",)))


def markdown_bbcode(value: Column) -> Column:
    """Markdown as BBCode; items in succession make one list."""
    rules = [(r"```\w*\n([\s\S]*?)```", "[code]$1[/code]"), (r"`([^`]+)`", "[font=Courier New]$1[/font]"), (r"!\[[^\]]*\]\(([^)]+)\)", "[img]$1[/img]"), (r"\[([^\]]+)\]\(([^)]+)\)", "[url=$2]$1[/url]")]
    rules += [(rf"(?m)^{marks}\s+(.+)$", f"[size={size}][b]$1[/b][/size]") for marks, size in _HEADINGS]
    rules += [(f"{mark}(.+?){mark}", "".join(f"[{t}]" for t in tags) + "$1" + "".join(f"[/{t}]" for t in reversed(tags))) for mark, tags in _EMPHASIS]
    rules.append((r"(?m)^>\s+(.+)$", "[quote]$1[/quote]"))
    for item, tag in (("[-*+]", "[list]"), (r"\d+\.", "[list=1]")):
        rules += [(rf"(?m)^{item}\s+(.+)$", f"{tag}\n[*]$1\n[/list]"), (re.escape("[/list]\n" + tag + "\n"), "")]
    for pattern, by in [*rules, (r"(?m)^[-*_]{3,}$", "[line]")]:
        value = F.regexp_replace(value, pattern, by)
    return value


def declared_functions(source: Column) -> Column:
    """Names of the functions that a script declares, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"\bfunction\s+([A-Za-z_][\w.:]*)\s*\("), 1))


def normalized_ids(value: Column) -> Column:
    """Pipe-joined ids: (ids without blanks, whether there are several)."""
    ids = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.array_join(ids, "|").alias("ids"), (F.size(ids) > 1).alias("several"))


# --- colours ------------------------------------------------------------------------------------


def bgra_to_rgba(value: Column) -> Column:
    """#AARRGGBB as #RRGGBBAA, null for any other length."""
    return F.when((F.length(value) == 9) & value.startswith("#"), F.concat(F.lit("#"), F.substring(value, 4, 6), F.substring(value, 2, 2)))


def css_to_argb(value: Column) -> Column:
    return F.when((F.length(value) == 7) & value.startswith("#"), F.concat(F.lit("#ff"), F.substring(value, 2, 6))).otherwise(value)


def argb_to_css(value: Column) -> Column:
    return F.when((F.length(value) == 9) & value.startswith("#"), F.concat(F.lit("#"), F.substring(value, 4, 6))).otherwise(value)


def luminance(value: Column) -> Column:
    """Relative luminance of #RRGGBB."""
    def channel(at: int) -> Column:
        c = F.conv(F.substring(value, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast_ratio(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
