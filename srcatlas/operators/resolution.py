"""Index-time resolution: modules and their configuration, class names and hierarchies, ordered chains, manifests."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import write_stage

CAP = 64
BUDGET = 200_000
_VARIANTS = {"typescript": ("", ".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".mjs", ".cjs", "/index.ts", "/index.js"), "luau": ("", ".luau", ".lua", "/init.luau", "/init.lua"), "dreammaker": ("", ".dm")}
_VARIANTS["javascript"] = _VARIANTS["typescript"]


def normal_path(path: str) -> str | None:
    """Path without '.' and '..'; null if it leaves the root."""
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def jsonc(text: str) -> object:
    """JSON with comments and trailing commas; strings are left alone."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text)
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))


def module_candidates(importer: str, spelled: str, language: str, config: dict | None = None, config_dir: str = "") -> list[str]:
    """Paths that an import may mean, in order: relative ones, then configured ones; empty for a package."""
    found: list[str] = []
    bases: list[str] = []
    if spelled.startswith("."):
        n = normal_path(importer.rsplit("/", 1)[0] + "/" + spelled if "/" in importer else spelled)
        bases = [n] if n is not None else []
    elif config:
        opts = config.get("compilerOptions", {}) if language in ("typescript", "javascript") else {}
        base = normal_path(f"{config_dir}/{opts.get('baseUrl', '.')}") or ""
        for pattern, targets in (opts.get("paths") or {}).items():
            head, star, tail = pattern.partition("*")
            if (star and spelled.startswith(head) and spelled.endswith(tail) and len(spelled) >= len(head) + len(tail)) or spelled == pattern:
                mid = spelled[len(head) : len(spelled) - len(tail)] if star else ""
                bases += [x for t in targets if (x := normal_path(f"{base}/{t.replace('*', mid, 1)}")) is not None]
        alias, _, rest = spelled.lstrip("@").partition("/")
        target = (config.get("aliases") or {}).get(alias)
        if target and (x := normal_path(f"{config_dir}/{target}/{rest}")) is not None:
            bases.append(x)
    for b in bases:
        for v in _VARIANTS.get(language, ("",)):
            found.append(b + v)
    return list(dict.fromkeys(found))[:CAP]


def nearest_config(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config): the deepest configuration in a directory above each path.  ``configs``: directory, config."""
    dirs = F.split("path", "/")
    up = paths.select("path", F.explode(F.sequence(F.lit(0), F.size(dirs) - 1)).alias("depth")).withColumn("directory", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/"))
    return up.join(configs, "directory").groupBy("path").agg(F.max_by("config", "depth").alias("config"))


def resolve_modules(imports: DataFrame, files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """(id, candidates, target) of imports (id, path, spelled, language): files among the paths an import may mean;
    a target only where one exact relative path is the only candidate."""
    i = imports
    if configs is not None:
        i = i.join(nearest_config(imports.select("path").distinct(), configs.select("directory", F.to_json(F.struct("directory", "config")).alias("config"))), "path", "left")
    else:
        i = i.withColumn("config", F.lit(None).cast("string"))

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def spread(path, spelled, language, config):
        c = json.loads(config) if config else None
        try:
            parsed = jsonc(c["config"]) if c else None
        except ValueError:
            parsed = None
        if parsed and "extends" in parsed:
            parsed = None
        return module_candidates(path, spelled, language, parsed, c["directory"] if c else "")

    rows = i.select("id", "spelled", F.posexplode(spread("path", "spelled", "language", "config")).alias("nth", "candidate"))
    hit = rows.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("id").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"), F.first("spelled").alias("spelled"), F.min("nth").alias("nth"))
    exact = (F.size("candidates") == 1) & F.col("spelled").startswith(".")
    return hit.select("id", "candidates", F.when(exact, F.element_at("candidates", 1)).alias("target"))


def class_key(name: Column) -> Column:
    """Key of a class name: without leading separators, ASCII lower case."""
    return F.translate(F.regexp_replace(name, r"^\\+", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def class_index(definitions: DataFrame, proxy_prefix: str = "XFCP_") -> DataFrame:
    """(key, classes): ids of the classes, interfaces, traits and enums of each name, proxies left out, at most ``CAP`` by id."""
    kinds = ("class", "interface", "trait", "enum")
    d = definitions.where(F.col("kind").isin(*kinds) & ~F.regexp_replace("name", r"^.*\\", "").startswith(proxy_prefix)).select(class_key(F.col("name")).alias("key"), "id").distinct()
    w = Window.partitionBy("key").orderBy("id")
    d = d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= CAP)
    return d.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("classes"))


def class_names(sites: DataFrame, index: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, candidates, owner): classes of other files that a site's name may mean, and the smallest definition around the site."""
    c = sites.select("id", "file_id", "span_start", "span_end", class_key(F.col("name")).alias("key")).join(index, "key")
    d = definitions.select(F.col("id").alias("class"), F.col("file_id").alias("class_file"))
    other = c.select("id", "file_id", F.explode("classes").alias("class")).join(d, "class").where("class_file <> file_id").groupBy("id").agg(F.array_sort(F.collect_set("class")).alias("candidates"))
    around = sites.select("id", "file_id", F.col("span_start").alias("a"), F.col("span_end").alias("b")).join(definitions.select(F.col("id").alias("owner"), "file_id", "span_start", "span_end"), "file_id")
    around = around.where("span_start <= a AND b <= span_end").groupBy("id").agg(F.min_by("owner", F.struct(F.col("span_end") - F.col("span_start"), "owner")).alias("owner"))
    return other.join(around, "id", "left")


def parent_status(classes: DataFrame, index: DataFrame) -> DataFrame:
    """(id, status, candidates) of classes with a parent (id, parent, conditional, complete): unsupported, conditional,
    incomplete, missing, ambiguous or single, in that order of precedence."""
    j = classes.where("parent IS NOT NULL").withColumn("key", class_key(F.col("parent"))).join(index, "key", "left")
    n = F.coalesce(F.size("classes"), F.lit(0))
    n = F.when(F.col("classes").isNull(), 0).otherwise(n)
    status = (
        F.when(F.col("parent").rlike(r"[^\w\\]"), "unsupported").when(F.col("conditional"), "conditional").when(~F.col("complete"), "incomplete").when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("single")
    )
    return j.select("id", status.alias("status"), F.coalesce("classes", F.array().cast("array<bigint>")).alias("candidates"))


def extends_edges(statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to the one safe parent, issues of all other classes)."""
    one = statuses.where("status = 'single'").select(F.col("id").alias("source"), F.element_at("candidates", 1).alias("target"), F.lit("extends_candidate").alias("kind"))
    return one.where("source <> target"), statuses.where("status <> 'single' OR element_at(candidates, 1) = id").select(F.col("id").alias("source"), F.when(F.col("status") == "single", "self").otherwise(F.col("status")).alias("issue"))


def parent_method(calls: DataFrame, edges: DataFrame, methods: DataFrame, rounds: int = CAP) -> DataFrame:
    """(call, method, hops): nearest concrete public or protected method of that name above the class of each call
    (id, class, name); a private or abstract one stops its branch.  ``methods``: id, class, name, visibility, abstract."""
    up = edges.select(F.col("source").alias("class"), F.col("target").alias("parent")).distinct()
    frontier = calls.select(F.col("id").alias("call"), "class", "name", F.array("class").alias("seen"))
    m = methods.select(F.col("class"), "name", F.col("id").alias("method"), "visibility", "abstract")
    out = None
    for hop in range(1, rounds + 1):
        nxt = frontier.join(up, "class").where(~F.array_contains("seen", F.col("parent"))).select("call", F.col("parent").alias("class"), "name", F.concat("seen", F.array("parent")).alias("seen"))
        found = write_stage(nxt.join(m, ["class", "name"], "left"), "parents")
        hit = found.where("method IS NOT NULL AND visibility <> 'private' AND NOT abstract").select("call", "method", F.lit(hop).alias("hops"))
        out = hit if out is None else out.unionByName(hit)
        frontier = found.where("method IS NULL").select("call", "class", "name", "seen")
        if frontier.isEmpty():
            break
    return out


def ordered_chain(registrations: DataFrame, most: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Edges (base, source, target, kind) and issues (base, issue) of registrations (base, implementation, priority).

    Per base, in order of priority: each implementation points to every peer of its priority
    (``tie``) and to every one of the priority before, or to the base.  With more than ``most`` classes, the
    base counted, a base gives an issue and no edge, so what is joined with itself is at most ``most`` rows.
    """
    r = registrations.where("base IS NOT NULL AND implementation IS NOT NULL AND priority IS NOT NULL").select("base", "implementation", "priority").distinct()
    size = r.groupBy("base").agg((F.countDistinct("implementation") + 1).alias("n"))
    big = size.where(F.col("n") > most).select("base")
    ok = r.join(big, "base", "left_anti").withColumn("g", F.dense_rank().over(Window.partitionBy("base").orderBy("priority")))
    a, b = ok.select("base", F.col("implementation").alias("source"), "g"), ok.select("base", F.col("implementation").alias("target"), F.col("g").alias("h"))
    tie = a.join(b, "base").where("g = h AND source <> target").select("base", "source", "target", F.lit("tie").alias("kind"))
    down = a.join(b, "base").where("h = g - 1").select("base", "source", "target", F.lit("previous").alias("kind"))
    first = a.where("g = 1").select("base", "source", F.col("base").alias("target"), F.lit("base").alias("kind"))
    return tie.unionByName(down).unionByName(first), big.select("base", F.lit("too_many_classes").alias("issue"))


def prepare_chains(registrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registrations of sound bases, issues): a whole base is blocked by an unknown or negative priority, an unknown
    activity, a duplicate pair, an implementation used for another base too, or an implementation of itself."""
    r = registrations
    pair = Window.partitionBy("base", "implementation")
    used = r.groupBy("implementation").agg(F.countDistinct("base").alias("bases"))
    j = r.withColumn("twice", F.count("*").over(pair) > 1).join(used, "implementation", "left")
    issue = (
        F.when(F.col("priority").isNull(), "unknown_order").when(F.col("priority") < 0, "negative_order").when(F.col("active").isNull(), "unknown_active").when(F.col("twice"), "duplicate")
        .when(F.col("bases") > 1, "reused").when(F.lower("base") == F.lower("implementation"), "self")
    )
    j = j.withColumn("issue", issue)
    issues = j.where("issue IS NOT NULL").select("base", "issue").distinct()
    return j.join(issues.select("base").distinct(), "base", "left_anti").where("active").select("base", "implementation", "priority"), issues


def parse_extensions(data: bytes) -> list[dict]:
    """Rows (from_class, to_class, active, execute_order) of an extension file; any fault empties the whole file."""
    try:
        root = ET.fromstring(data)
        out = []
        for e in root.iter("extension"):
            active, order = e.attrib["active"], e.attrib["execute_order"]
            if active not in ("0", "1") or not re.fullmatch(r"-?\d+", order) or not e.attrib["from_class"] or not e.attrib["to_class"]:
                return []
            out.append({"from_class": e.attrib["from_class"], "to_class": e.attrib["to_class"], "active": active == "1", "execute_order": int(order)})
        return out
    except (ET.ParseError, KeyError, ValueError):
        return []


def parse_requirements(text: str) -> list[dict]:
    """Keys of a manifest's ``require`` object with their byte spans, repeated ones flagged; empty if it isn't sound JSON."""
    try:
        if not isinstance(json.loads(text).get("require"), dict):
            return []
    except (ValueError, AttributeError):
        return []
    raw = text.encode()
    at = re.search(rb'"require"\s*:\s*\{', raw)
    depth, i, out, seen = 1, at.end(), [], set()
    while depth:
        m = re.compile(rb'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]').search(raw, i)
        i = m.end()
        c = m[0][:1]
        if c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
        elif m[2] and depth == 1:
            k = json.loads(b'"' + m[1] + b'"')
            out.append({"key": k, "start": m.start(1), "end": m.end(1), "repeated": k in seen})
            seen.add(k)
    return out


def alias_name(rules: list[tuple[str, str]], name: Column) -> Column:
    """Canonical class name by (namespace prefix, suffix) rules: the first whose prefix holds, ASCII case ignored."""
    out = name
    for prefix, suffix in reversed(rules):
        out = F.when(class_key(name).startswith(prefix.lower() + "\\"), F.concat(name, F.lit(suffix))).otherwise(out)
    return out


def charged(derived: list[DataFrame], budget: int = BUDGET) -> int:
    """Rows of all derived tables, charged one table after the other; an error ends the publication where they exceed the budget."""
    spent = 0
    for d in derived:
        spent = charge(spent, d.count(), budget)
    return spent


def charge(spent: int, more: int, budget: int = BUDGET) -> int:
    """Derived edges and candidates so far; an error beyond the budget ends the publication."""
    if spent + more > budget:
        raise RuntimeError(f"derived facts exceed {budget}")
    return spent + more
