"""Joins of facts: prefixes, intervals, best matches and preferences, all as equi-joins with a stated order of ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column, sep: str = "/") -> Column:
    """A path and all its leading parts, longest first, down to the empty one."""
    parts = F.filter(F.split(path, sep), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def longest_prefix(rows: DataFrame, owners: DataFrame, key: str, path: str, prefix: str, owner: str, sep: str = "/") -> DataFrame:
    """`rows` with `owner`: that of the deepest `prefix` that contains their path by whole parts; null if none does.

    Rows explode into their ancestors and meet owners by equality, so nothing is compared by range. Of owners with
    one prefix the least counts.
    """
    known = owners.select(F.array_join(F.filter(F.split(prefix, sep), lambda p: p != ""), sep).alias("_p"), F.col(owner)).groupBy("_p").agg(F.min(owner).alias(owner))
    steps = rows.select(key, F.explode(ancestors(F.col(path), sep)).alias("_p"))
    best = steps.join(known, "_p").groupBy(key).agg(F.max_by(owner, F.length("_p")).alias(owner))
    return rows.join(best, key, "left")


def dictionary(rows: DataFrame, names: DataFrame, key: str, name: str, sep: str = ".") -> DataFrame:
    """`rows` with the entry of `names` (name, prefix boolean, entry) that equals their name or, for prefixes, leads it.

    `_` and `-` are one character. The longest match wins; names that match nothing keep a null entry.
    """
    plain = F.regexp_replace(F.lower(F.col(name)), "_", "-")
    entries = names.select(F.regexp_replace(F.lower("name"), "_", "-").alias("_n"), "prefix", "entry")
    asked = rows.select(key, plain.alias("_full"), F.explode(ancestors(plain, f"[{sep}]" if sep == "." else sep)).alias("_raw"))
    asked = asked.select(key, "_full", F.when(F.lit(sep == "."), F.regexp_replace("_raw", r"\[\.\]", ".")).otherwise(F.col("_raw")).alias("_n"))
    met = asked.join(entries, "_n").where((F.col("_n") == F.col("_full")) | F.col("prefix"))
    best = met.groupBy(key).agg(F.max_by("entry", F.struct(F.length("_n"), "entry")).alias("entry"))
    return rows.join(best, key, "left")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _open(segment: Column) -> Column:
    return segment.startswith("{")


def _fits(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: (x == y) | _open(x) | _open(y)), lambda ok: ok)


#: Marks under which operations and calls with parameters register; no path holds them. Segments that a face shows.
_ANY, _PARAMETER, _ROOT, _CUT, _SHOWN = "\u0001*", "\u0001{", "\u0001/", "\u0002", 5


def _shown(segments: Column) -> Column:
    """The segments of a path that its face shows: all, or the first two and the last three."""
    n = F.size(segments)
    return F.when(n <= _SHOWN, segments).otherwise(F.concat(F.slice(segments, 1, 2), F.slice(segments, F.greatest(n - 2, F.lit(1)), F.lit(3))))


def _face(segments: Column) -> Column:
    """An operation's face: its literals, and a mark for each parameter."""
    return F.array_join(F.transform(_shown(segments), lambda s: F.when(_open(s), F.lit(_PARAMETER)).otherwise(s)), _CUT)


def _faces(segments: Column) -> Column:
    """The faces of the operations that a call without parameters may reach: each of its segments as it is, or a parameter."""
    shown = _shown(segments)
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(shown)) - 1)
    bit = lambda mask, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1
    return F.transform(masks, lambda mask: F.array_join(F.transform(shown, lambda s, i: F.when(bit(mask, i), F.lit(_PARAMETER)).otherwise(s)), _CUT))


def _ends(segments: Column, asked: bool) -> list[Column]:
    """What a path registers under at its first and at its last segment.

    A call asks for its own literal and for parameters, or for anything where it has a parameter itself; an operation
    stands under its literal or the mark of a parameter, and under that of anything. So a pair that can fit meets once.
    """
    out = []
    for at in (F.lit(0), F.size(segments) - 1):
        one = F.get(segments, at)
        named = F.when(_open(one), F.lit(_PARAMETER)).otherwise(one)
        faces = F.when(_open(one), F.array(F.lit(_ANY))).otherwise(F.array(one, F.lit(_PARAMETER))) if asked else F.array(named, F.lit(_ANY))
        out.append(F.when(F.size(segments) == 0, F.array(F.lit(_ROOT))).otherwise(faces))
    return out


def _registered(rows: DataFrame, segments: Column, asked: bool) -> DataFrame:
    first, last = _ends(segments, asked)
    return rows.withColumn("first", F.explode(first)).withColumn("last", F.explode(last))


def best_match(calls: DataFrame, operations: DataFrame, scope: str | None = None) -> DataFrame:
    """`calls` (call_id, unit, method, path) with operation: the one operation of another unit that fits best, else null.

    `operations` has operation, unit, method, path, path_partial. Paths of as many segments score 1000 and one for each
    pair of segments that are equal or both parameters; a partial operation that ends a longer call scores 500 and its
    length; an operation that a shorter call ends scores 100 and the call's length. A tie for the best gives null.
    With `scope`, a column of both, only operations of the call's scope count, and only they can tie.
    Candidates meet by equality: a call without parameters under the 2^k faces of the operations that may fit it, of
    which an operation has one; a call with parameters by both ends of its path.
    """
    area = F.col(scope) if scope else F.lit(0)
    c = calls.select(area.alias("area"), "call_id", "unit", "method", _segments(F.col("path")).alias("cs")).withColumn("cn", F.size("cs"))
    o = operations.select(area.alias("area"), "operation", F.col("unit").alias("ounit"), F.col("method").alias("m"), "path_partial", _segments(F.col("path")).alias("os")).withColumn("on", F.size("os"))
    c = c.withColumn("m", F.explode(F.array_distinct(F.array(F.col("method"), F.lit("ANY"))))).drop("method")
    other, keys = F.col("unit") != F.col("ounit"), ["area", "m", "n", "first", "last"]

    def met(asked: DataFrame, offered: DataFrame, ct: Column, ot: Column) -> DataFrame:
        loose, columns = F.exists(ct, _open), ["call_id", "operation", "cs", "os", "cn", "on"]
        plain = asked.where(~loose).withColumn("face", F.explode(_faces(ct))).join(offered.withColumn("face", _face(ot)), ["area", "m", "n", "face"])
        ends = _registered(asked.where(loose), ct, True).join(_registered(offered, ot, False), keys)
        return plain.where(other & _fits(ct, ot)).select(*columns).unionByName(ends.where(other & _fits(ct, ot)).select(*columns))

    whole = met(c.withColumn("n", F.col("cn")), o.withColumn("n", F.col("on")), F.col("cs"), F.col("os"))
    alike = F.zip_with("cs", "os", lambda x, y: (x == y) | (_open(x) & _open(y)))
    whole = whole.select("call_id", "operation", (F.lit(1000) + F.size(F.filter(alike, lambda x: x))).alias("score"))
    # the call is longer: every shorter tail of it may be a partial operation
    tails = c.where("cn > 1").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("cn") - 1))).withColumn("ct", F.slice("cs", F.col("cn") - F.col("n") + 1, F.col("n")))
    ends = met(tails, o.where("path_partial and on > 0").withColumn("n", F.col("on")), F.col("ct"), F.col("os")).select("call_id", "operation", (F.lit(500) + F.col("on")).alias("score"))
    # the operation is longer: its tails meet calls of their length
    longer = o.where("on > 1").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("on") - 1))).withColumn("ot", F.slice("os", F.col("on") - F.col("n") + 1, F.col("n")))
    starts = met(c.where("cn > 0").withColumn("n", F.col("cn")), longer, F.col("cs"), F.col("ot")).select("call_id", "operation", (F.lit(100) + F.col("cn")).alias("score"))
    scored = whole.unionByName(ends).unionByName(starts).groupBy("call_id", "score").agg(F.count("*").alias("n"), F.min("operation").alias("operation"))
    best = scored.groupBy("call_id").agg(F.max(F.struct("score", "n", "operation")).alias("b"))
    return calls.join(best.select("call_id", F.when(F.col("b.n") == 1, F.col("b.operation")).alias("operation"), F.col("b.score").alias("score")), "call_id", "left")


def innermost(points: DataFrame, intervals: DataFrame, scope: str, at: str, bucket: int) -> DataFrame:
    """`points` with the smallest interval (id, lo, hi, both ends included) of their scope that contains them, else null.

    Intervals register in every bucket they touch, points in their one, so the join is by equality and the bucket size
    bounds how many intervals a point meets. Ties: the later begin, then the lesser id.
    """
    spans = intervals.select(scope, "id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("_b"))
    met = points.withColumn("_b", F.floor(F.col(at) / bucket)).join(spans, [scope, "_b"], "left").where(F.col("id").isNull() | F.col(at).between(F.col("lo"), F.col("hi")))
    rank = F.struct(F.col("hi") - F.col("lo"), -F.col("lo"), "id")
    keys = points.columns
    best = met.where("id is not null").groupBy(*keys).agg(F.min_by("id", rank).alias("id"))
    return points.join(best, keys, "left")


def overlapping(a: DataFrame, b: DataFrame, scope: str, bucket: int) -> DataFrame:
    """Pairs of intervals (aid, alo, ahi) and (bid, blo, bhi) of one scope that share a point, each pair once.

    Both sides register in the buckets they touch; a pair counts in the bucket of its first common point only.
    """
    x = a.select(scope, "aid", "alo", "ahi", F.explode(F.sequence(F.floor(F.col("alo") / bucket), F.floor(F.col("ahi") / bucket))).alias("_b"))
    y = b.select(scope, "bid", "blo", "bhi", F.explode(F.sequence(F.floor(F.col("blo") / bucket), F.floor(F.col("bhi") / bucket))).alias("_b"))
    first = F.floor(F.greatest("alo", "blo") / bucket)
    return x.join(y, [scope, "_b"]).where((F.col("alo") <= F.col("bhi")) & (F.col("ahi") >= F.col("blo")) & (F.col("_b") == first)).drop("_b")


def prefer_own(accesses: DataFrame, entities: DataFrame, alias: str = "alias", owner: str = "unit") -> DataFrame:
    """`accesses` (access_id, alias, unit) with entity: one of the same unit if it is the only such, else the only one of any.

    Entities are counted by alias and owner, and by alias, before accesses meet them, so an access meets one row of each.
    """
    known = entities.select(alias, owner, "entity").where(F.col("entity").isNotNull()).distinct()
    own = known.groupBy(alias, owner).agg(F.count("*").alias("no"), F.min("entity").alias("eo"))
    # an entity that several units own is one of any
    every = known.groupBy(alias).agg(F.min("entity").alias("ea"), F.max("entity").alias("eb"))
    pick = F.when(F.col("no") == 1, F.col("eo")).when(F.col("no").isNull() & (F.col("ea") == F.col("eb")), F.col("ea"))
    return accesses.join(own, [alias, owner], "left").join(every, alias, "left").withColumn("entity", pick).select(*accesses.columns, "entity")


def by_variants(rows: DataFrame, names: DataFrame, key: str, variants: Column) -> DataFrame:
    """`rows` with the id of the first of their `variants` (an ordered array) that `names` (name, id) has; the least id on a tie."""
    asked = rows.select(key, F.posexplode(variants).alias("_i", "name"))
    best = asked.join(names, "name").groupBy(key).agg(F.min(F.struct("_i", "id")).alias("_b"))
    return rows.join(best.select(key, F.col("_b.id").alias("id")), key, "left")


def publish_listen(published: DataFrame, listened: DataFrame, event: str = "event", module: str = "module", at: str = "at") -> DataFrame:
    """src, dst, weight, first_at: modules that publish and other modules that listen to one event, with the number of sites.

    Sites are counted per (event, module) before they meet, so the join's rows are modules, not sites.
    """
    p = published.groupBy(event, F.col(module).alias("src")).agg(F.count("*").alias("p"), F.min(at).alias("first"))
    q = listened.groupBy(event, F.col(module).alias("dst")).agg(F.count("*").alias("q"))
    met = p.join(q, event).where("src <> dst")
    return met.groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("weight"), F.min("first").alias("first_at"))


def selected(selectors: DataFrame, objects: DataFrame, scope: str = "namespace") -> DataFrame:
    """sid, oid: objects whose labels include all pairs of a selector (map) of their scope; empty selectors select nothing.

    A selector meets objects by its pairs, exploded on either side; those that meet in all of them are selected.
    """
    s = selectors.select(scope, "sid", F.size("selector").alias("need"), F.explode("selector").alias("k", "v"))
    o = objects.select(scope, "oid", F.explode("labels").alias("k", "v"))
    return s.join(o, [scope, "k", "v"]).groupBy("sid", "oid", "need").agg(F.count("*").alias("n")).where("n = need").select("sid", "oid")


def nearest_name(asked: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """`asked` (name) with suggestion: the known name of the least edit distance, letters compared in lower case.

    The distance may be at most a third of the longer name's bytes, and at least 1 is allowed; ties go to the lesser
    name. Candidates meet by length, and what 62 groups of letters they hold has to agree but for two an edit.
    """
    a, b = F.lower(F.col("a")), F.lower(F.col("b"))
    distance = F.levenshtein(a, b)
    limit = F.greatest(F.lit(1), F.floor(F.greatest(F.octet_length("a"), F.octet_length("b")) / 3)).cast("int")
    # names within the limit differ in length by at most it, so candidates meet by length: in the window of the name with more bytes
    def sized(df: DataFrame, c: str) -> DataFrame:
        bits = F.transform(F.array_distinct(F.transform(F.split(F.lower(F.col(c)), ""), lambda x: F.pmod(F.hash(x), F.lit(62)))), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))
        held = F.aggregate(bits, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))
        return df.select(F.col(name).alias(c)).distinct().select(c, F.length(F.lower(F.col(c))).alias("n"), held.alias(f"{c}_held"))

    def window(df: DataFrame, c: str) -> DataFrame:
        reach = F.greatest(F.lit(1), F.floor(F.octet_length(c) / 3)).cast("int")
        return df.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - reach), F.col("n") + reach)))

    x, y = sized(asked, "a"), sized(known, "b")
    alike = F.bit_count(F.col("a_held").bitwiseXOR(F.col("b_held"))) <= 2 * limit
    met = window(x, "a").join(y, "n").where(alike).select("a", "b").unionByName(x.join(window(y, "b"), "n").where((F.octet_length("b") > F.octet_length("a")) & alike).select("a", "b"))
    met = met.withColumn("d", distance).where(F.col("d") <= limit)
    best = met.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(F.col("a").alias(name), F.col("m.b").alias("suggestion"), F.col("m.d").alias("distance"))
    return asked.join(best, name, "left")


def ant_to_regex(pattern: Column) -> Column:
    """An Ant path pattern as a regular expression: `?` a character, `*` within a part, `**` any parts, `{x}` a part."""
    safe = F.regexp_replace(pattern, r"([.+^$()\[\]|\\])", r"\\$1")
    out = F.regexp_replace(safe, r"\{[^/}]*\}", "[^/]+")
    out = F.regexp_replace(out, r"/\*\*$", "(\u0001)?")
    out = F.regexp_replace(out, r"\*\*/", "(\u0002)?")
    out = F.regexp_replace(out, r"\*\*", ".\u0003")
    out = F.regexp_replace(out, r"\*", "[^/]*")
    out = F.regexp_replace(out, r"(?<!\))\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(out, F.lit("\u0001"), F.lit("/.*")), F.lit("\u0002"), F.lit(".*/")), F.lit("\u0003"), F.lit("*")), F.lit("$"))


def first_rule(operations: DataFrame, rules: DataFrame) -> DataFrame:
    """`operations` (unit, operation, path) with the requirement of their unit's first rule (pos, pattern) that matches."""
    r = rules.select("unit", "pos", ant_to_regex(F.col("pattern")).alias("re"), "requirement")
    met = operations.select("unit", "operation", "path").join(r, "unit").where(F.expr("path rlike re"))
    best = met.groupBy("unit", "operation").agg(F.min_by("requirement", "pos").alias("requirement"))
    return operations.join(best, ["unit", "operation"], "left")


def only_implementor(interfaces: DataFrame, classes: DataFrame, scope: str = "unit") -> DataFrame:
    """`interfaces` (scope, interface, methods) with the one class of their scope that has all their methods, else null."""
    need = interfaces.select(scope, "interface", F.size(F.array_distinct("methods")).alias("need"), F.explode(F.array_distinct("methods")).alias("m"))
    have = classes.select(scope, "class", F.explode(F.array_distinct("methods")).alias("m"))
    full = need.join(have, [scope, "m"]).groupBy(scope, "interface", "class", "need").agg(F.count("*").alias("n")).where("n = need")
    only = full.groupBy(scope, "interface").agg(F.count("*").alias("k"), F.min("class").alias("class")).where("k = 1").drop("k")
    return interfaces.join(only, [scope, "interface"], "left")


def by_priority(rows: DataFrame, candidates: list[DataFrame], key: str, value: str) -> DataFrame:
    """`rows` with the value of the first of `candidates` (key, value, ord) that has their key; the least ord within it."""
    all_of = None
    for n, c in enumerate(candidates):
        part = c.select(key, value, F.lit(n).alias("_p"), F.col("ord").alias("_o"))
        all_of = part if all_of is None else all_of.unionByName(part)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_p", "_o", value))
    best = all_of.withColumn("_r", first).where("_r = 1").select(key, value)
    return rows.join(best, key, "left")


def named_services(literals: DataFrame, services: DataFrame, scope: str = "repo") -> DataFrame:
    """scope, unit, pos, value, service: literals (scope, unit, pos, value) of other units that name a service.

    `services` has scope and service, names of a-z, 0-9 and `-`. A literal names one that begins right behind a `://`
    in it, or if it is the service's name in capitals, `_` for `-`, with `_URL`, `_SERVICE_URL`, `_HOST` or `_ADDR`.
    So `http://pay-api` names both `pay` and `pay-api`. The beginnings of what follows `://` and the four variables of
    a service meet by equality, each distinct text once; a literal that names a service twice is one row.
    """
    texts = literals.where("value is not null").select(scope, "value").distinct()
    runs = texts.select(scope, "value", F.explode(F.regexp_extract_all("value", F.lit("://([a-z0-9-]+)"), F.lit(1))).alias("run"))
    begun = runs.select(scope, "value", F.explode(F.transform(F.sequence(F.lit(1), F.length("run")), lambda n: F.substring("run", F.lit(1), n))).alias("service"))
    known = services.where("service is not null").select(scope, "service").distinct()
    capital = F.upper(F.translate("service", "-", "_"))
    variables = known.select(scope, "service", F.explode(F.array(*[F.concat(capital, F.lit(x)) for x in ("_URL", "_SERVICE_URL", "_HOST", "_ADDR")])).alias("value"))
    met = begun.join(known, [scope, "service"]).unionByName(texts.join(variables, [scope, "value"])).distinct()
    return literals.select(scope, "unit", "pos", "value").join(met, [scope, "value"]).where("unit <> service").select(scope, "unit", "pos", "value", "service").distinct()
