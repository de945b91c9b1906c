"""Scalar functions as column expressions; none needs a user function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_text(text: Column, most: int) -> Column:
    """White space collapsed; what is longer than ``most`` ends in three dots."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity, also below zero, unlike SQL's round."""
    scale = F.lit(float(10**digits))
    return F.floor(x.cast("double") * scale + F.lit(0.5)) / scale


def finding_id(file: Column, line: Column, kind: Column) -> Column:
    """Twelve hexadecimal digits of a hash of place and kind."""
    return F.substring(F.sha2(F.concat_ws(":", file, F.coalesce(line, F.lit(0)).cast("string"), kind), 256), 1, 12)


def normalise_name(name: Column) -> Column:
    """Lower case, only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+", " "))


def name_tokens(name: Column) -> Column:
    """Distinct words of a normalised name that have more than two characters."""
    return F.array_distinct(F.filter(F.split(normalise_name(name), " "), lambda w: F.length(w) > 2))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger set's size; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def near_boundary(value: Column, thresholds: Sequence[float], share: float = 0.2) -> Column:
    """Whether a value is within ``share`` of any threshold other than zero."""
    hit = F.lit(False)
    for t in thresholds:
        if t:
            hit = hit | (F.abs(value - F.lit(float(t))) / F.lit(float(t)) <= F.lit(share))
    return hit


def template_to_route(url: Column) -> Column:
    """Back ticks go; ``${name}`` becomes ``[name]``."""
    return F.regexp_replace(F.regexp_replace(url, "`", ""), r"\$\{\s*([^}]+?)\s*\}", "[$1]")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``${name}`` of a known name gives way to its value; others stay."""
    for name, v in values.items():
        template = F.replace(template, F.lit("${" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def fill_printf(template: Column, args: Column) -> Column:
    """``%s %i %d %f %j %p`` take the next of the string array ``args``; ``%%`` is
    a percent sign; a mark without an argument stays."""
    cut = F.split(F.regexp_replace(template, r"%([sidfjp%])", "\u0001$1\u0002"), "\u0001")
    start = F.struct(F.element_at(cut, 1).alias("out"), F.lit(1).alias("next"))

    def step(acc: Column, piece: Column) -> Column:
        mark, rest = F.substring(piece, 1, 1), F.substring(piece, F.lit(3), F.length(piece))
        arg = F.try_element_at(args, acc["next"])
        text = F.when(mark == "%", F.lit("%")).otherwise(F.coalesce(arg, F.concat(F.lit("%"), mark)))
        return F.struct(F.concat(acc["out"], text, rest).alias("out"), (acc["next"] + F.when(mark == "%", 0).otherwise(1)).alias("next"))

    return F.aggregate(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), start, step)["out"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), d).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1)


def common_ancestor(paths: Column) -> Column:
    """The longest run of leading directories that all paths share."""
    parts = F.transform(paths, lambda p: F.split(dir_name(p), "/"))
    first = F.element_at(parts, 1)
    n = F.aggregate(
        F.sequence(F.lit(1), F.size(first)),
        F.lit(0),
        lambda acc, k: F.when((acc == k - 1) & F.forall(parts, lambda p: F.try_element_at(p, k).eqNullSafe(F.element_at(first, k))), k).otherwise(acc),
    )
    return F.array_join(F.slice(first, 1, n), "/")


def glob_to_regex(glob: str) -> str:
    """``*`` stops at a slash, ``**`` doesn't; the whole path must match."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + ("\\" + glob[k] if glob[k] in ".^$+{}()|[]\\" else glob[k]), k + 1
    return f"^{out}$"


def cells(row: Column) -> Column:
    """The cells of a table row between pipes, trimmed, without blank ends."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(row), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def dependencies(text: Column) -> Column:
    """Names between commas and white space; dashes mean none."""
    return F.filter(F.split(F.trim(text), r"[,\s]+"), lambda d: (d != "") & ~d.rlike("^[-–—]+$"))


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"]|['\"]$", "")


def setter_mirrors(setter: Column, value: Column, prefixes: Sequence[str] = ("initial", "default", "current", "is", "has", "selected")) -> Column:
    """Whether ``setX`` sets a copy of x: the same name in any case, or after one of the prefixes."""
    name, v = F.lower(F.regexp_replace(setter, "^set", "")), F.lower(value)
    hit = name == v
    for p in prefixes:
        hit = hit | (F.concat(F.lit(p), name) == v)
    return setter.startswith("set") & hit


def bytes_text(n: Column) -> Column:
    one = lambda unit, size: F.concat(F.format_string("%.1f", round_half_up(n / F.lit(float(size)), 1)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, one("KB", 1 << 10)).otherwise(one("MB", 1 << 20))


def percent_text(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


# Versions -----------------------------------------------------------------


def version(text: Column) -> Column:
    """major, minor, patch (null where missing) and pre-release parts."""
    p = r"^[v=\s]*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    part = lambda k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).cast("int")
    pre = F.regexp_extract(text, p, 4)
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.when(pre != "", F.split(pre, r"\.")).alias("pre"))


def version_key(v: Column) -> Column:
    """A string that sorts as versions do: a pre-release is below its release,
    numeric parts are below others and sort by number."""
    pad = lambda c: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), 10, "0")
    part = lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("1"), F.lpad(x, 10, "0"))).otherwise(F.concat(F.lit("2"), x))
    pre = F.when(v["pre"].isNull(), F.lit("~")).otherwise(F.array_join(F.transform(v["pre"], part), "!"))
    return F.concat_ws(".", pad(v["major"]), pad(v["minor"]), pad(v["patch"]), pre)


def _bound(major: Column, minor: Column, patch: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("string"), 10, "0")
    return F.concat_ws(".", pad(major), pad(minor), pad(patch))


def _comparator_holds(v: Column, key: Column, comparator: Column) -> Column:
    """One comparator: caret, tilde, wildcard, partial or an operator with a version."""
    op = F.regexp_extract(comparator, r"^(\^|~|>=|<=|>|<|=)?", 1)
    bare = F.trim(F.regexp_replace(comparator, r"^(\^|~|>=|<=|>|<|=)\s*", ""))
    clean = F.regexp_replace(bare, r"(\.[xX*])+(?=$|-)", "")
    w = version(clean)
    zero = F.lit(0)
    major, minor, patch = (F.coalesce(w[x], zero) for x in ("major", "minor", "patch"))
    low = F.concat(_bound(major, minor, patch), F.when(w["pre"].isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.split_part(version_key(w), F.lit("."), F.lit(4)))))
    exact = w["patch"].isNotNull()
    caret = F.when((major > 0) | w["minor"].isNull(), _bound(major + 1, zero, zero)).when((minor > 0) | w["patch"].isNull(), _bound(major, minor + 1, zero)).otherwise(_bound(major, minor, patch + 1))
    tilde = F.when(w["minor"].isNull(), _bound(major + 1, zero, zero)).otherwise(_bound(major, minor + 1, zero))
    above = F.when(w["minor"].isNull(), _bound(major + 1, zero, zero)).when(w["patch"].isNull(), _bound(major, minor + 1, zero)).otherwise(_bound(major, minor, patch + 1))
    mine = _bound(F.coalesce(v["major"], zero), F.coalesce(v["minor"], zero), F.coalesce(v["patch"], zero))
    full = F.when(w["pre"].isNull() & exact, F.concat(low, F.lit(".~"))).otherwise(low)
    at_least = key >= F.when(w["pre"].isNull(), F.when(exact, F.concat(low, F.lit(".~"))).otherwise(F.concat(low, F.lit(".")))).otherwise(low)
    return (
        F.when(bare.isin("", "*", "x", "X", "latest"), F.lit(True))
        .when(w["major"].isNull(), F.lit(False))
        .when(op == "^", at_least & (mine < caret))
        .when(op == "~", at_least & (mine < tilde))
        .when(op == ">=", at_least)
        .when(op == ">", F.when(exact, key > full).otherwise(mine >= above))
        .when(op == "<=", F.when(exact, key <= full).otherwise(mine < above))
        .when(op == "<", key < F.when(w["pre"].isNull(), F.when(exact, F.concat(low, F.lit(".~"))).otherwise(low)).otherwise(low))
        .otherwise(F.when(exact, key == full).otherwise((mine >= _bound(major, minor, patch)) & (mine < above)))
    )


def satisfies(installed: Column, wanted: Column) -> Column:
    """Whether a version is in a range: alternatives by ``||``, comparators by
    spaces, hyphen ranges, ``^ ~ > >= < <= =``, wildcards and partial versions."""
    v = version(F.trim(installed))
    key = version_key(v)
    hyphen = F.regexp_replace(wanted, r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2")
    glued = F.regexp_replace(hyphen, r"(\^|~|>=|<=|>|<|=)\s+", "$1")
    every = lambda part: F.forall(F.filter(F.split(F.trim(part), r"\s+"), lambda c: c != ""), lambda c: _comparator_holds(v, key, c))
    return v["major"].isNotNull() & F.exists(F.split(glued, r"\|\|"), every)


def command_class(command: Column) -> Column:
    """What a shell command does; the first rule that matches."""
    c = F.lower(F.trim(command))
    rules = (("typecheck", r"\btsc\b|type-?check|\bmypy\b"), ("test", r"\b(vitest|jest|pytest|playwright)\b|\btest\b"), ("build", r"\bbuild\b"), ("lint", r"\b(eslint|prettier|ruff|lint)\b"), ("git", r"^git\b"), ("npm", r"^(npm|pnpm|yarn|npx)\b"), ("tool", r"\bast-\w+"))
    out = F.lit("other")
    for name, p in reversed(rules):
        out = F.when(c.rlike(p), F.lit(name)).otherwise(out)
    return out
