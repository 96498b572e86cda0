"""Scalar column functions. Each takes Columns (or names) and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP codes worth another attempt, and those that never are.
TRANSIENT = (408, 429, 500, 502, 503, 504)
PERMANENT = (400, 401, 403, 404, 409)
#: File endings and their media types.
MEDIA_TYPES = {
    ".txt": "text/plain",
    ".html": "text/html",
    ".htm": "text/html",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".msg": "application/vnd.ms-outlook",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unquote(x) -> Column:
    """Trimmed, without one pair of equal quotes around it."""
    t = F.trim(_c(x))
    quoted = (F.length(t) >= 2) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")))
    return F.when(quoted, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def normalize_path(x) -> Column:
    """Slashes forward, "." and empty segments gone, ".." taking the segment before it."""
    parts = F.split(F.replace(_c(x), F.lit("\\"), F.lit("/")), "/")
    rooted = F.replace(_c(x), F.lit("\\"), F.lit("/")).startswith("/")

    def step(stack, part):
        top = F.try_element_at(stack, F.lit(-1))
        up = (part == "..") & (F.size(stack) > 0) & (top != "..")
        return (
            F.when((part == "") | (part == "."), stack)
            .when(up, F.slice(stack, 1, F.size(stack) - 1))
            .when((part == "..") & rooted, stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    ends = F.when(F.replace(_c(x), F.lit("\\"), F.lit("/")).rlike("[^/]/+$") & (joined != ""), F.lit("/")).otherwise("")
    out = F.concat(F.when(rooted, "/").otherwise(""), joined, ends)
    return F.when(out == "", ".").otherwise(out)


def has_value(x) -> Column:
    return F.coalesce(F.length(F.trim(_c(x))) > 0, F.lit(False))


def filter_values(x) -> Column:
    """The comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def percentage(passed, total) -> Column:
    """One decimal and a per cent sign; n/a of nothing. format_string rounds the exact quotient half up."""
    p, t = _c(passed), _c(total)
    return F.when(t == 0, "n/a").otherwise(F.format_string("%.1f%%", p / t * 100))


def ratio(passed, total) -> Column:
    return F.concat_ws("/", _c(passed).cast("string"), _c(total).cast("string"))


def criterion_kind(name) -> Column:
    n = F.coalesce(_c(name), F.lit(""))
    return F.when(n.startswith("prompt/"), "prompt").when(n.startswith("language/"), "language").otherwise("other")


def markdown_cell(x) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def first_group(x, pattern: str) -> Column:
    """The first group of a pattern in multi-line mode, null if it doesn't match."""
    found = F.regexp_extract(_c(x), f"(?m){pattern}", 1)
    return F.when(_c(x).rlike(f"(?m){pattern}"), found)


def _bucket_word(flag, user) -> Column:
    return F.substring(F.sha2(F.concat(_c(flag), F.lit(":"), _c(user)), 256), 1, 16)


def rollout_bucket(flag, user) -> Column:
    """The first 8 bytes of SHA-256(flag:user) as an unsigned number, modulo 100."""
    return F.pmod(F.conv(_bucket_word(flag, user), 16, 10).cast("decimal(20,0)"), F.lit(100)).cast("long")


def rollout_bucket_signed(flag, user) -> Column:
    """The same bytes as a signed number, floor modulo 100."""
    unsigned = F.conv(_bucket_word(flag, user), 16, 10).cast("decimal(20,0)")
    wide = unsigned.cast("decimal(21,0)")
    signed = F.when(wide >= F.lit(str(2**63)).cast("decimal(21,0)"), wide - F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(wide)
    return F.pmod(signed, F.lit(100)).cast("long")


def rollout_percentile(flag, user) -> Column:
    """The same bytes, unsigned, in hundredths of a per cent: 0.00 to 99.99."""
    return (F.pmod(F.conv(_bucket_word(flag, user), 16, 10).cast("decimal(20,0)"), F.lit(10000)).cast("double")) / 100


def feature_percentage(conditions, name: str = "Percentage") -> Column:
    """parameters.Value of the first client filter of that name, with or without a vendor before a dot, in a JSON text."""
    kind = "struct<conditions:struct<client_filters:array<struct<name:string,parameters:struct<Value:double>>>>>"
    filters = F.from_json(_c(conditions), kind)["conditions"]["client_filters"]
    return F.try_element_at(F.filter(filters, lambda f: F.element_at(F.split(f["name"], r"\."), -1) == name), F.lit(1))["parameters"]["Value"]


def feature_enabled(flag, user, percent) -> Column:
    return rollout_bucket(flag, user) < _c(percent)


_SUBJECT = r"/containers/([^/]+)/blobs/(.+)$"


def subject_container(subject) -> Column:
    return _subject(subject, 1)


def subject_blob(subject) -> Column:
    """Percent escapes are decoded; a plus sign stays one."""
    return F.try_url_decode(F.replace(_subject(subject, 2), F.lit("+"), F.lit("%2B")))


def _subject(subject, group: int) -> Column:
    """A part of a subject; null of a malformed one."""
    return F.when(_c(subject).rlike(_SUBJECT), F.regexp_extract(_c(subject), _SUBJECT, group))


def checked_subject(subject) -> Column:
    """(container, blob) of a subject; a malformed or null one is an error."""
    bad = F.raise_error(F.concat(F.lit("Unexpected event subject: "), F.coalesce(_c(subject), F.lit("null")))).cast("struct<container:string,blob:string>")
    return F.when(F.coalesce(_c(subject).rlike(_SUBJECT), F.lit(False)), F.struct(subject_container(subject).alias("container"), subject_blob(subject).alias("blob"))).otherwise(bad)


def blob_url(signed_url, path) -> Column:
    """Scheme, host and query of a signed address with another path."""
    u = _c(signed_url)
    query = F.try_parse_url(u, F.lit("QUERY"))
    head = F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(u, F.lit("AUTHORITY")), F.lit("/"), F.ltrim(_c(path), F.lit("/")))
    return F.when(query.isNull(), head).otherwise(F.concat(head, F.lit("?"), query))


def retry_class(code) -> Column:
    c = _c(code)
    return F.when(c.isin(*TRANSIENT), "transient").when(c.isin(*PERMANENT), "permanent").otherwise("other")


def status_message(code) -> Column:
    c = _c(code)
    return F.when(c == 404, "not found").when(c == 403, "forbidden").when(c == 409, "conflict").when(c == 429, "throttled").otherwise("other")


def retry_delay(headers) -> Column:
    """Milliseconds to wait: the exact header, else the one in seconds; null without either."""
    h = _c(headers)
    return F.coalesce(F.try_element_at(h, F.lit("retry-after-ms")).cast("double"), F.try_element_at(h, F.lit("retry-after")).cast("double") * 1000)


def media_type(path) -> Column:
    """The media type of a file's ending; an unknown ending is an error."""
    ending = F.lower(F.regexp_extract(_c(path), r"(\.[^./\\]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ending), F.raise_error(F.concat(F.lit("Unsupported file type: "), ending)))


def supported_answer(citations, text) -> Column:
    """With a citation, and not said to be unsupported."""
    return (F.coalesce(F.size(_c(citations)), F.lit(0)) > 0) & ~F.upper(F.ltrim(_c(text))).startswith("UNSUPPORTED:")


def context_text(parts) -> Column:
    return F.array_join(_c(parts), "\n\n")


def typed_field(variant, path: str, kind: str, required: bool = False) -> Column:
    """A field of a VARIANT if it has the kind (string, number or boolean); another kind is an error, and null too if required."""
    raw = F.try_variant_get(_c(variant), path, "variant")
    shape = F.schema_of_variant(raw)
    fits = {"string": shape == "STRING", "boolean": shape == "BOOLEAN", "number": shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")}[kind]
    target = {"string": "string", "boolean": "boolean", "number": "double"}[kind]
    absent = raw.isNull() | (shape == "VOID")
    bad = F.raise_error(F.lit(f"{path} must be a {kind}")).cast(target)
    return F.when(absent, bad if required else F.lit(None).cast(target)).when(fits, F.try_variant_get(_c(variant), path, target)).otherwise(bad)


def safe_path(x) -> Column:
    """Only letters, digits and ``._/-``, relative, and not leaving the root once normalized."""
    p = normalize_path(x)
    return _c(x).rlike(r"^[A-Za-z0-9._/-]+$") & ~p.startswith("/") & ~p.rlike(r"^\.\.(/|$)")


def insert_after(text, anchor: str, addition: str) -> Column:
    """The text with an addition behind the first match of an anchor (multi-line); unchanged without one."""
    at = F.regexp_instr(_c(text), F.lit(f"(?m){anchor}"))
    end = at - 1 + F.length(F.regexp_extract(_c(text), f"(?m){anchor}", 0))
    return F.when(at == 0, _c(text)).otherwise(F.concat(_c(text).substr(F.lit(1), end), F.lit(addition), _c(text).substr(end + 1, F.length(_c(text)))))


#: Commands that are scripts on one platform and need its shell there, and how that is called.
SHELL_COMMANDS, SHELL, SHELL_ARGS = ("npm", "npx"), "cmd.exe", ("/d", "/s", "/c")


def shell_commands(text, platform) -> Column:
    """A spec whose ``command:`` lines name the shell where the platform (win32) needs it: the command becomes its last argument. Only commands that have a list of arguments right after them are changed."""
    args = "".join(rf"$1  - {a}\n" for a in SHELL_ARGS)
    changed = F.regexp_replace(_c(text), F.lit(rf"(?m)^(\s+)command: ({'|'.join(SHELL_COMMANDS)})\r?\n\1args:\r?\n"), F.lit(f"$1command: {SHELL}\n$1args:\n{args}$1  - $2\n".replace("\\n", "\n")))
    return F.when(_c(platform) == "win32", changed).otherwise(_c(text))


def distinct_values(x) -> Column:
    return F.array_distinct(filter_values(x))


def composite_key(*columns) -> Column:
    """A key of several columns; parts can't run into each other as in joined text."""
    return F.struct(*columns)
