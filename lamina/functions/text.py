"""Text predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide the text risks. Case folding and word boundaries are Unicode's.
SENSITIVE = (
    r"(?iuU)(\b\d{1,3}(?:[.,]\d{3})+(?:\s*(?:đồng|vnd|vnđ|usd))?\b"
    r"|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
    r"|\b\d{9,12}\b"
    r"|\b(?:số|so|mã|ma|mst|cccd|cmnd|hợp\s*đồng|hop\s*dong|đơn|don)\b)"
)
AMBIGUOUS = r"(?U)\b(?=[A-Za-z0-9?]{3,}\b)(?=[A-Za-z?]*[OolIlS?])(?=[A-Za-z0-9?]*\d)[A-Za-z0-9?/-]+\b"
CHECKBOX = r"(?iuU)(\[[ xX]\]|☐|☑|✓|□|■|checkbox|tick|chọn|chon)"
# Patterns of text that is no content, block types in order of precedence, and file kinds.
GARBAGE = (r"^•+$", r"^[0-9]{1,2} / ?[0-9]{1,2}$", r"^[0-9]{1,2} of [0-9]{1,2}$", r"^http://[^ ]{12,}", r"\(cid *: *[0-9]+ *\)")
BLOCK_TYPES = (
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^(20|19)[0-9]{2}年$", "Dt"),
    (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    (r"^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    (r"^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    (r"^.{1}$", "Sg"),
)
CAPTION = r"^[图表]+[ 0-9:：]{2,}"
FILE_KINDS = (
    ("pdf", "pdf"),
    ("doc", "eml|doc|docx|ppt|pptx|yml|xml|htm|json|csv|txt|ini|xls|xlsx|wps|rtf|hlp|pages|numbers|key|md|py|js|java|c|cpp|h|php|go|ts|sh|cs|kt|html|sql"),
    ("aural", "wav|flac|ape|alac|wavpack|wv|mp3|aac|ogg|vorbis|opus"),
    ("visual", "jpg|jpeg|png|tif|gif|pcx|tga|exif|fpx|svg|psd|cdr|pcd|dxf|ufo|eps|ai|raw|webp|avif|apng|icon|ico|mpg|mpeg|avi|rm|rmvb|mov|wmv|asf|dat|asx|wvx|mpe|mpa|mp4"),
)
UPLOADS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")


def stripped(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sensitive(text: Column) -> Column:
    return text.rlike(SENSITIVE)


def ambiguous(text: Column) -> Column:
    return text.rlike(AMBIGUOUS)


def checkbox(text: Column) -> Column:
    return text.rlike(CHECKBOX)


def too_short(text: Column, area: Column, least_area: int = 120_000, density: float = 0.00025) -> Column:
    n = F.length(stripped(text))
    return (n > 0) & (area >= least_area) & (n < density * area)


def risk_categories(text: Column, area: Column | None = None) -> Column:
    """The categories of a text in fixed order; an empty text has none."""
    short = too_short(text, area) if area is not None else F.lit(False)
    flags = ((sensitive(text), "sensitive_value"), (ambiguous(text), "ambiguous_characters"), (checkbox(text), "checkbox_or_selection"), (short, "ocr_too_short_for_region"))
    found = F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, n in flags]))
    return F.when(stripped(text) == "", F.array().cast("array<string>")).otherwise(found)


def severity(category: Column) -> Column:
    return F.when(category.isin("sensitive_value", "ambiguous_characters", "multi_column_page", "table_or_form_block"), "high").otherwise("medium")


def passthrough(text: Column) -> Column:
    """Markdown lines that no heading rule may touch."""
    return (stripped(text) == "") | stripped(text).rlike(r"^(#|\||!\[|```|- |\+ |\* )")


def heading_candidate(text: Column, most: int = 140) -> Column:
    n = F.length(stripped(text))
    return (n >= 3) & (n <= most) & text.rlike(r"\p{L}")


def garbage(text: Column) -> Column:
    out = F.lit(False)
    for p in GARBAGE:
        out = out | text.rlike(p)
    return out


def block_type(text: Column) -> Column:
    out = None
    for p, kind in BLOCK_TYPES:
        test = stripped(text).rlike(p)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def caption(text: Column, layout_type: Column) -> Column:
    return stripped(text).rlike(CAPTION) | F.coalesce(layout_type.contains("caption"), F.lit(False))


def file_kind(name: Column) -> Column:
    out = None
    for kind, endings in FILE_KINDS:
        test = F.lower(name).rlike(rf"\.({endings})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def may_upload(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)).isin(*UPLOADS)


def safe_filename(name: Column) -> Column:
    base = F.trim(F.regexp_extract(name, r"([^/]*)/*$", 1))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}._\- ()]", "")), F.lit("")), F.lit("upload"))


def slug(label: Column, default: str = "image") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def asset_name(page: Column, region: Column, label: Column) -> Column:
    return F.format_string("page_%03d_region_%03d_%s.png", page, region, slug(label))


def artifact_paths(page_path: Column) -> list[Column]:
    """The document's output files beside a page image."""
    folder = F.regexp_extract(page_path, r"^(.*)/[^/]*$", 1)
    base = F.concat(folder, F.lit("/"), F.regexp_extract(folder, r"([^/]*)$", 1))
    names = ("full.md", "metadata.json", "ocr_raw.md", "vlm_checked.md", "vlm_review.json")
    return [F.concat(base, F.lit(f"_{n}")).alias(n.replace(".", "_")) for n in names]


def lossy(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def preview(content: Column, most: int) -> list[Column]:
    """The first bytes as text, damaged characters replaced, and whether there are more."""
    cut = lossy(F.substring(content, 1, most))
    return [cut.alias("preview"), (F.octet_length(content) > most).alias("truncated")]


def shortened(text: Column, most: int, marker: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def rule_id(wrong: Column, correct: Column) -> Column:
    return F.substring(F.sha2(F.concat(wrong, F.lit("\0"), correct), 256), 1, 16)


def json_reply(reply: Column) -> Column:
    """The JSON object inside a model's reply: code fences dropped, first { to last }."""
    bare = F.regexp_replace(stripped(reply), r"^```(?:json)?\s*|\s*```$", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def token_usage(usage: Column, labels: tuple[tuple[str, str], ...]) -> Column:
    """label=value of what is there, in order."""
    parts = [F.when(F.get_json_object(usage, f"$.{key}").isNotNull(), F.concat(F.lit(f"{label}="), F.get_json_object(usage, f"$.{key}"))) for key, label in labels]
    return F.concat_ws(", ", *parts)


def postcheck_status(metadata: Column) -> Column:
    post = F.coalesce(F.get_json_object(metadata, "$.ai_postcheck"), F.get_json_object(metadata, "$.gemini_postcheck"))
    return (
        F.when(post.isNotNull(), F.coalesce(F.nullif(F.get_json_object(post, "$.status"), F.lit("")), F.lit("unknown")))
        .when(F.coalesce(metadata, F.lit("{}")) != "{}", "disabled")
        .otherwise("unavailable")
    )


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def from_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def to_millis(text: Column) -> Column:
    return F.unix_millis(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"))


#: Numbers of the padding, start, end and mask symbols; characters follow from 4 (fixed values).
PAD, START, END, MASK = range(4)


def encode(text: Column, alphabet: str) -> Column:
    numbers = F.create_map(*[x for i, c in enumerate(alphabet) for x in (F.lit(c), F.lit(i + 4))])
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(START)), F.transform(chars, lambda c: F.element_at(numbers, c)), F.array(F.lit(END)))


def decode(ids: Column, alphabet: str) -> Column:
    """What stands between the start, if any, and the first end, if any."""
    names = F.array(*[F.lit(c) for c in ("<pad>", "<sos>", "<eos>", "*", *alphabet)])
    first = F.when(F.array_contains(ids, START), 2).otherwise(1)
    end = F.array_position(ids, END)
    n = F.greatest(F.lit(0), F.when(end > 0, end).otherwise(F.size(ids) + 1) - first)
    return F.array_join(F.transform(F.slice(ids, first, n.cast("int")), lambda i: F.element_at(names, i + 1)), "")


def right_to_left(text: Column) -> Column:
    """Characters reversed, but runs of Latin letters, digits and their signs kept in order."""
    return F.array_join(F.reverse(F.regexp_extract_all(text, F.lit(r"(?s)([a-zA-Z0-9 :*./%+-]+|.)"), 1)), "")


def user_file(path: Column) -> Column:
    """The file of a user's own version of a checked text."""
    return F.when(path.rlike("_(vlm|gemini)_checked\\.md$"), F.regexp_replace(path, "_(vlm|gemini)_checked\\.md$", "_vlm_user.md")).otherwise(
        F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_user.md"))
    )


def log_tail(content: Column, offset: Column, most: int = 512 * 1024) -> list[Column]:
    """Text from a byte offset on and the offset after it; an offset past the end starts anew."""
    at = F.when((offset < 0) | (offset > F.octet_length(content)), 0).otherwise(offset)
    part = F.substring(content, (at + 1).cast("int"), F.lit(most))
    return [lossy(part).alias("text"), (at + F.octet_length(part)).cast("long").alias("offset")]


def review_status(enabled: Column, run: Column, failed: Column) -> Column:
    return F.when(~enabled, "disabled").when(~run, "skipped").when(failed, "failed").otherwise("ok")


def to_second(ms: Column) -> Column:
    """Milliseconds cut to whole seconds."""
    return (F.floor(ms / 1000) * 1000).cast("long")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds between two times in milliseconds, as text ``HH:MM:SS`` shows them; never below 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor((later - earlier) / 1000).cast("long"))


def encoded(value: Column) -> Column:
    """A struct as JSON: times as ``yyyy-MM-dd HH:mm:ss``, fields without a value left out."""
    return F.to_json(value, {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})


def decoded(text: Column, schema: str) -> Column:
    """JSON read by an explicit schema; null where it is not of it."""
    return F.from_json(text, schema, {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})


def class_label(number: Column, names: tuple[str, ...]) -> Column:
    """The name of a class in lower case; null out of range."""
    return F.lower(F.when(number >= 0, F.get(F.array(*map(F.lit, names)), number.cast("int"))))


def scored_enough(kind: Column, score: Column, least: float = 0.08, visual: float = 0.4, visuals: tuple[str, ...] = ("figure", "equation")) -> Column:
    """Above the layout threshold, and for visual kinds at their own."""
    return (score > least) & ~(kind.isin(*visuals) & (score < visual))


def compact_regions(regions: Column) -> Column:
    """Of each region what a review sees: content and layout type, and the asset's path where there is one."""
    return F.transform(regions, lambda r: F.struct(r["type"].alias("layout_type"), F.nullif(r["asset_path"], F.lit("")).alias("asset_path")))


def resolved(path: Column) -> Column:
    """An absolute path without empty and ``.`` steps, each ``..`` taking back the step before it; above the root there is nothing."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    back = lambda had, s: F.when(s == "..", F.slice(had, F.lit(1), F.greatest(F.size(had) - 1, F.lit(0)))).otherwise(F.concat(had, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), back), "/"))


def contained(path: Column, root: Column) -> Column:
    """``path``, resolved, where it lies at or below ``root``; else null. A relative path begins at the root of all."""
    at, top = resolved(path), F.regexp_replace(resolved(root), "/$", "")
    return F.when((F.coalesce(path, F.lit("")) != "") & (at.eqNullSafe(top) | at.startswith(F.concat(top, F.lit("/")))), at)
