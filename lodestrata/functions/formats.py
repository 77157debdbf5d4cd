"""Small formats as column expressions: rules, owners, validity, reference lists, keys and frames.

What cannot be read gives null (or a struct whose `error` says why); an operator that must stop raises on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of layers that can be read; names of partitions and namespaces with their codes; codes of
#: frames; HTTP statuses that are worth another try.
LAYER_TYPES = (
    "application/vnd.oci.image.layer.v1.tar",
    "application/vnd.docker.image.rootfs.diff.tar",
    "application/vnd.oci.image.layer.nondistributable.v1.tar",
    "application/vnd.oci.image.layer.v1.tar+gzip",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+gzip",
    "application/vnd.docker.image.rootfs.diff.tar.gzip",
    "application/vnd.docker.image.rootfs.foreign.diff.tar.gzip",
    "application/vnd.oci.image.layer.v1.tar+zstd",
    "application/vnd.oci.image.layer.nondistributable.v1.tar+zstd",
)
PARTITIONS = {"chunk": 1, "manifest": 2, "blob": 3}
REQUEST_HEADER, RESPONSE_HEADER, LARGEST_FRAME = 39, 8, 4 << 20
GENERATION = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
MOST_GENERATIONS = 1024
RETRY_STATUS = (408, 429, 499, 500, 502, 503, 504, 520, 521, 522, 523, 524)


def parse_rule(s: Column) -> Column:
    """A path rule `archive[:target]` as struct (tar, fs, prefix, error).

    A slash at the end of the archive side makes it a rule for a folder. Without a colon the target is the archive side as
    written; an empty target is the current folder, or the file's name; "-" is the standard output, for files only.
    """
    colon = F.instr(s, ":") > 0
    left = F.when(colon, F.substring_index(s, ":", 1)).otherwise(s)
    right = F.when(colon, F.regexp_replace(s, "(?s)^[^:]*:", "")).otherwise("")
    parts = F.filter(F.split(left, "/"), lambda x: (x != "") & (x != "."))
    tar, up, root = F.array_join(parts, "/"), F.array_contains(parts, ".."), F.size(parts) == 0
    folder = left.endswith("/")
    prefix = folder | root

    def bare(c: Column) -> Column:
        c = F.regexp_replace(c, "/$", "")
        return F.when(c == "", "/").otherwise(c)

    name = F.element_at(parts, -1)
    fs = F.when(~colon, F.when(prefix, bare(left)).otherwise(left)).when(right == "", F.when(prefix, ".").otherwise(name)).when(right == "-", "-").otherwise(bare(right))
    error = (
        F.when(s == "", "empty")
        .when(up, "leaves the archive")
        .when(root & ~colon, "the archive's root needs a target")
        .when(root & ~folder & (right != "") & ~right.endswith("/"), "the archive's root needs a folder")
        .when((right == "-") & prefix, "only a file goes to the standard output")
        .when(~prefix & (right != "-") & right.endswith("/"), "a file needs a file as its target")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, tar).alias("tar"), F.when(ok, fs).alias("fs"), F.when(ok, prefix).alias("prefix"), error.alias("error"))


def parse_owner(s: Column, users: dict[str, tuple[int, int]] | None = None, groups: dict[str, int] | None = None) -> Column:
    """"uid:gid", "user:group", "user" (with its first group) or "1000" (twice) as struct (uid, gid); null if it is none.

    Names come from `users` (uid, first gid) and `groups`; "name:name" without such a group takes the user's first one.
    """
    users, groups = users or {}, groups or {}

    def look(c: Column, table: dict[str, int]) -> Column:
        out = F.when(c.rlike(r"^[0-9]{1,9}\z"), c.cast("int"))
        for k, v in table.items():
            out = out.when(c == k, v)
        return out

    user, group = F.split_part(s, F.lit(":"), F.lit(1)), F.regexp_replace(s, "(?s)^[^:]*:", "")
    first = {k: v[1] for k, v in users.items()}
    uid, both = look(user, {k: v[0] for k, v in users.items()}), s.contains(":")
    gid = F.when(both, F.coalesce(look(group, groups), F.when(user == group, look(group, first)))).otherwise(look(user, first))
    return F.when(uid.isNotNull() & gid.isNotNull(), F.struct(uid.alias("uid"), gid.alias("gid")))


def _top() -> Column:
    return F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")


def checked_add(a: Column, b: Column) -> Column:
    """The sum of unsigned 64-bit numbers (as decimals), null beyond 2**64 - 1."""
    out = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.when(out <= _top().cast("decimal(21,0)"), out.cast("decimal(20,0)"))


def checked_mul(a: Column, b: Column) -> Column:
    """The product of unsigned 64-bit numbers, null beyond 2**64 - 1. A quotient says so before anything overflows."""
    fits = (b == 0) | (a <= F.floor(_top() / F.when(b == 0, F.lit(1)).otherwise(b).cast("decimal(20,0)")))
    return F.when(fits, (a.cast("decimal(20,0)") * F.when(fits, b).cast("decimal(18,0)")).cast("decimal(20,0)"))


def node_type(mode: Column) -> Column:
    """What a file mode's type bits stand for."""
    kinds = {1: "fifo", 2: "char", 4: "dir", 6: "block", 8: "file", 10: "link", 12: "socket"}
    bits, out = F.shiftright(mode, 12).bitwiseAND(15), F.lit(None).cast("string")
    for k, v in kinds.items():
        out = F.when(bits == k, v).otherwise(out)
    return out


def device_number(major: Column, minor: Column) -> Column:
    """Major and minor numbers in the 32-bit form: low eight bits of the minor, twelve of the major, the rest of the minor."""
    minor = minor.cast("bigint")
    return minor.bitwiseAND(0xFF).bitwiseOR(F.shiftleft(major.cast("bigint"), 8)).bitwiseOR(F.shiftleft(minor - minor % 256, 12))


def layer_retry_delay_ms(attempt: Column) -> Column:
    return attempt.cast("bigint") * 5000


def retry_reason(kind: Column, status: Column) -> Column:
    """Why a failed pull is worth another try; null if it is not. kind: http, dns_timeout, dns_temporary, dns, timeout,
    temporary, eof, connection, or another (cancelled, local files, ...)."""
    return (
        F.when((kind == "http") & status.isin(*RETRY_STATUS), F.concat(F.lit("http_"), status.cast("string")))
        .when(kind.isin("dns_timeout", "dns_temporary"), kind)
        .when(kind == "timeout", "network_timeout")
        .when(kind == "temporary", "temporary_network_error")
        .when(kind == "eof", "unexpected_eof")
        .when(kind == "connection", "connection_error")
    )


def is_permanent(kind: Column, marked: Column) -> Column:
    """Whether reading again cannot help: as an error is marked (retryable or not); unmarked ones by kind: an object that is
    not there, or whose bytes are wrong, stays so."""
    return F.when(marked.isNotNull(), ~marked).otherwise(kind.isin("not_found", "corrupt", "invalid", "unsupported"))


def parse_valid_at(s: Column, now: Column) -> Column:
    """"imported[ expires]" as the time of import, null if it cannot be read or does not hold at `now`."""
    form = r"^\s*(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,9})?(?:Z|[+-]\d\d:\d\d))(?:\s+(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,9})?(?:Z|[+-]\d\d:\d\d)))?\s*$"
    first, second = (F.try_to_timestamp(F.nullif(F.regexp_extract(s, form, i), F.lit(""))) for i in (1, 2))
    has_second = F.regexp_extract(s, form, 2) != ""
    ok = first.isNotNull() & (first <= now) & (~has_second | (second.isNotNull() & (second > first) & (now < second)))
    return F.when(ok, first)


def format_valid_at(imported: Column, days: Column | None = None) -> Column:
    """What is written beside a record: its import, and when it expires, if it does (days above zero)."""
    form = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    out = F.date_format(imported, form)
    if days is None:
        return out
    later = F.date_format(imported + F.make_dt_interval(days=days), form)
    return F.when(days > 0, F.concat_ws(" ", out, later))


def readable_layer(media_type: Column) -> Column:
    return F.coalesce(media_type.isin(*LAYER_TYPES), F.lit(False))


def encode_refs(refs: Column, most: int = 64) -> Column:
    """An ordered list of references, each on a line; null if it is empty, too long, or has a repeated or unfit one."""
    fit = F.forall(refs, lambda r: r.rlike(r"^[^\s#][^\r\n]*\z") & (F.trim(r) == r))
    ok = (F.size(refs) > 0) & (F.size(refs) <= most) & fit & (F.size(F.array_distinct(refs)) == F.size(refs))
    return F.when(ok, F.concat(F.array_join(refs, "\n"), F.lit("\n")))


def parse_refs(text: Column, most: int = 64) -> Column:
    """The references of such a list, in order; null if it is not exactly what encode_refs gives."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return F.when(encode_refs(lines, most) == text, lines)


def cache_key(partition: Column, kind: Column, key: Column) -> Column:
    """A cache's key: version, partition, kind (1 object, 2 shard) and the 32 bytes of a hex content key; null if unfit."""
    code = F.lit(None).cast("int")
    for name, i in PARTITIONS.items():
        code = F.when(partition == name, i).otherwise(code)
    ok = code.isNotNull() & kind.isin(1, 2) & key.rlike(r"^[0-9a-f]{64}\z")
    return F.when(ok, F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(code.cast("bigint")), 2, "0"), F.lpad(F.hex(kind.cast("bigint")), 2, "0"), key)))


def _little(n: Column, width: int) -> Column:
    h = F.lpad(F.hex(n.cast("bigint")), 2 * width, "0")
    return F.concat(*(F.substring(h, 2 * (width - i) - 1, 2) for i in range(width)))


def _from_little(data: Column, at: int, width: int) -> Column:
    h = F.concat(*(F.hex(F.substring(data, at + width - i, 1)) for i in range(width)))
    return F.conv(h, 16, 10).cast("bigint")


def _octet(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("int")


def encode_request(opcode: Column, namespace: Column, flags: Column, key: Column, value: Column) -> Column:
    """A request frame: total length, opcode, namespace, flags, 32 bytes of key, value."""
    value = F.coalesce(value, F.lit(b""))
    head = F.concat(_little(F.octet_length(value) + REQUEST_HEADER, 4), *(F.lpad(F.hex(c.cast("bigint")), 2, "0") for c in (opcode, namespace, flags)))
    return F.concat(F.unhex(head), key, value)


def decode_request(frame: Column) -> Column:
    """A request frame as struct (opcode, namespace, flags, key, value); null if its length is wrong or out of bounds."""
    n = _from_little(frame, 0, 4)
    ok = (n >= REQUEST_HEADER) & (n <= LARGEST_FRAME) & (n == F.octet_length(frame))
    return F.when(ok, F.struct(_octet(frame, 4).alias("opcode"), _octet(frame, 5).alias("namespace"), _octet(frame, 6).alias("flags"), F.substring(frame, 8, 32).alias("key"), F.substring(frame, F.lit(REQUEST_HEADER + 1), F.octet_length(frame)).alias("value")))


def encode_response(status: Column, error: Column, value: Column) -> Column:
    """A response frame: total length, status, a reserved byte, the error's length, the error, value."""
    e, value = F.encode(F.coalesce(error, F.lit("")), "utf-8"), F.coalesce(value, F.lit(b""))
    head = F.concat(_little(F.octet_length(e) + F.octet_length(value) + RESPONSE_HEADER, 4), F.lpad(F.hex(status.cast("bigint")), 2, "0"), F.lit("00"), _little(F.octet_length(e), 2))
    return F.concat(F.unhex(head), e, value)


def decode_response(frame: Column) -> Column:
    """A response frame as struct (status, error, value); null if its lengths do not fit."""
    n, e = _from_little(frame, 0, 4), _from_little(frame, 6, 2)
    ok = (n >= RESPONSE_HEADER) & (n <= LARGEST_FRAME) & (n == F.octet_length(frame)) & (e + RESPONSE_HEADER <= n)
    error = F.decode(F.substring(frame, F.lit(RESPONSE_HEADER + 1), e.cast("int")), "utf-8")
    return F.when(ok, F.struct(_octet(frame, 4).alias("status"), error.alias("error"), F.substring(frame, (e + RESPONSE_HEADER + 1).cast("int"), F.octet_length(frame)).alias("value")))


def bench_key(i: Column, warm: int, cold: int, access: str, miss_milli: int, seed: int = 1) -> Column:
    """The key that step i of a benchmark reads: of `warm` keys in turn (seq), evenly (uniform) or by rank (zipf, exponent
    1.1), or with a chance of miss_milli / 1000 one of `cold` keys that stand after them. A hash of the step decides, so
    steps are independent of each other."""

    def chance(salt: int) -> Column:
        return (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    if access == "seq":
        hot = i % warm
    elif access == "uniform":
        hot = F.floor(chance(1) * warm)
    else:  # inverse of the continuous law with the same tail
        hot = F.least(F.floor(F.pow(F.lit(1.0) - chance(1) * (1 - float(warm + 1) ** -0.1), F.lit(-10.0))) - 1, F.lit(warm - 1))
    if not (miss_milli and cold):
        return hot.cast("bigint")
    return F.when(chance(2) * 1000 < miss_milli, warm + F.floor(chance(3) * cold)).otherwise(hot).cast("bigint")


def generation_salt(name: Column, domain: str) -> Column:
    """The salt of a generation within a domain, null if the name is not one."""
    return F.when(is_generation(name), F.unhex(F.sha2(F.concat(F.encode(F.lit(domain), "utf-8"), F.encode(name, "utf-8")), 256)))


def is_generation(name: Column) -> Column:
    return F.coalesce(name.rlike(GENERATION), F.lit(False))


def generations_problem(names: Column) -> Column:
    """What is wrong with a list of generations, oldest first; null if nothing is."""
    bad = F.filter(names, lambda n: ~is_generation(n))
    return F.when(F.size(names) == 0, "empty").when(F.size(names) > MOST_GENERATIONS, "too many").when(F.size(bad) > 0, F.concat(F.lit("unsafe: "), F.element_at(bad, 1))).when(F.size(F.array_distinct(names)) < F.size(names), "repeated")


def resolve_file(ref: Column, locations: Column, folder: Column) -> Column:
    """Where a parsed file reference (a struct of parse_ref) is: in the folder that its location's name stands for (a map;
    null if it has none), at its absolute path, or below `folder`."""
    path, where = ref["path"], F.try_element_at(locations, ref["location"])
    inside = F.concat_ws("/", F.regexp_replace(where, "/$", ""), path)
    plain = F.when(path.startswith("/") | (folder == ""), path).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/$", ""), path))
    return F.when(ref["scheme"] != "file", F.lit(None)).when(ref["location"].isNotNull(), F.when(where.isNotNull(), inside)).otherwise(plain)
