"""Deployment files: compose files with their environments and overlays, Kubernetes manifests, Helm values."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.config import placeholder
from factloom.sources.files import extract

COMPOSE = "name string, build_dir string, dockerfile_dir string, image string, publishes_ports boolean, depends_on array<string>, environment array<struct<key:string,value:string>>, env_files array<string>, line int, variant string"
WORKLOADS = "kind string, name string, namespace string, image string, ports array<string>, replicas string, schedule string, labels map<string,string>, selector map<string,string>, target string, env array<struct<key:string,value:string>>, line int"
#: Bytes of a Kubernetes manifest that are read; a fixed value.
MAX_MANIFEST = 512 * 1024


def _join(base: str, path: str) -> str:
    parts: list[str] = []
    for p in f"{base}/{path}".split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def _pairs(env) -> list[dict]:
    if isinstance(env, dict):
        return [{"key": str(k), "value": "" if v is None else str(v)} for k, v in env.items()]
    out = []
    for x in env or ():
        k, _, v = str(x).partition("=")
        out.append({"key": k, "value": v})
    return out


def variant_of(path: str) -> str | None:
    """`prod` of docker-compose.prod.yml; null for a base file."""
    m = re.match(r"(?:docker-)?compose\.([\w.-]+)\.ya?ml$", path.rsplit("/", 1)[-1])
    return m[1] if m else None


def compose(path: str, text: str) -> list[dict]:
    doc = yaml.safe_load(text) or {}
    folder, out = path.rpartition("/")[0], []
    for name, s in (doc.get("services") or {}).items():
        s = s or {}
        build, depends = s.get("build"), s.get("depends_on") or []
        context = build if isinstance(build, str) else (build or {}).get("context", ".") if build else None
        context = context and _join(folder, placeholder(str(context), {}))
        docker = (build.get("dockerfile") if isinstance(build, dict) else None) or ""
        files = s.get("env_file") or []
        line = re.search(rf"(?m)^\s+[\"']?{re.escape(str(name))}[\"']?\s*:", text)
        out.append({
            "name": str(name), "build_dir": context, "dockerfile_dir": _join(context or folder, docker.rpartition("/")[0]) if "/" in docker else context,
            "image": s.get("image") and placeholder(str(s["image"]), {}), "publishes_ports": bool(s.get("ports")), "depends_on": sorted(map(str, depends)),
            "environment": _pairs(s.get("environment")), "env_files": [_join(folder, f if isinstance(f, str) else f.get("path", "")) for f in ([files] if isinstance(files, str) else files)],
            "line": text.count("\n", 0, line.start()) + 1 if line else 1, "variant": variant_of(path),
        })
    return out


def compose_services(files: DataFrame) -> DataFrame:
    """The services of compose files in the root and its deployment folders, base files and variants."""
    return extract(files, compose, COMPOSE, F.col("path").rlike(r"^(?:(?:docker|deploy|deployment|infra|ops)/(?:[^/]+/)*)?(?:docker-)?compose(?:\.[\w.-]+)?\.ya?ml$"))


def overlays(services: DataFrame) -> DataFrame:
    """repo, folder, variant, adds, changes: what each variant's services add to and change of the base file beside it."""
    tagged = services.where("error is null").select("repo", F.regexp_replace("path", "[^/]*$", "").alias("folder"), "variant", "name")
    base = tagged.where("variant is null").groupBy("repo", "folder").agg(F.collect_set("name").alias("base"))
    over = tagged.where("variant is not null").groupBy("repo", "folder", "variant").agg(F.collect_set("name").alias("over"))
    none = F.array().cast("array<string>")
    met = over.join(base, ["repo", "folder"], "left").withColumn("base", F.coalesce("base", none))
    return met.select("repo", "folder", "variant", F.array_sort(F.array_except("over", "base")).alias("adds"), F.array_sort(F.array_intersect("over", "base")).alias("changes"))


def render_values(text: str, values: dict) -> str | None:
    """A Helm template of values only, rendered; null if it has control flow, which isn't read."""
    if re.search(r"\{\{-?\s*(?:if|range|with|define|include|template|end|else)\b", text):
        return None

    def put(m: re.Match) -> str:
        at = values
        for part in m[1].split("."):
            at = at.get(part) if isinstance(at, dict) else None
        default = m[2]
        return str(at if at is not None else (default or "").strip("\"' "))

    return re.sub(r"\{\{-?\s*\.Values\.([\w.]+)\s*(?:\|\s*default\s+([^|}]+?))?(?:\|\s*quote\s*)?-?\}\}", put, text)


def kubernetes(path: str, text: str) -> list[dict]:
    """Workloads, services and ingresses of a manifest, told by content, not by name."""
    if len(text.encode()) > MAX_MANIFEST or "kind:" not in text:
        return []
    out = []
    for doc in yaml.safe_load_all(text):
        if not isinstance(doc, dict) or "kind" not in doc or not isinstance(doc.get("metadata"), dict):
            continue
        kind, meta, spec = doc["kind"], doc["metadata"], doc.get("spec") or {}
        line = re.search(rf"(?m)^\s*name:\s*[\"']?{re.escape(str(meta.get('name')))}[\"']?\s*$", text)
        row = {"kind": kind, "name": str(meta.get("name")), "namespace": meta.get("namespace") or "default", "ports": [], "labels": {}, "selector": {}, "env": [], "line": text.count("\n", 0, line.start()) + 1 if line else 1}
        if kind in ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob"):
            job = (spec.get("jobTemplate") or {}).get("spec") or {} if kind == "CronJob" else spec
            pod = job.get("template") or {}
            boxes = (pod.get("spec") or {}).get("containers") or [{}]
            row |= {
                "image": boxes[0].get("image"), "ports": [str(p.get("containerPort")) for b in boxes for p in b.get("ports") or ()], "replicas": str(spec["replicas"]) if "replicas" in spec else None, "schedule": spec.get("schedule"),
                "labels": {str(k): str(v) for k, v in ((pod.get("metadata") or {}).get("labels") or {}).items()}, "env": [{"key": str(e.get("name")), "value": str(e.get("value") or "")} for b in boxes for e in b.get("env") or ()],
            }
        elif kind == "Service":
            row |= {"selector": {str(k): str(v) for k, v in (spec.get("selector") or {}).items()}, "ports": [str(p.get("port")) for p in spec.get("ports") or ()]}
        elif kind == "Ingress":
            backends = [p.get("backend") or {} for r in spec.get("rules") or () for p in (r.get("http") or {}).get("paths") or ()]
            names = [(b.get("service") or {}).get("name") or b.get("serviceName") for b in backends]
            out += [{**row, "target": n} for n in dict.fromkeys(n for n in names if n)]
            continue
        else:
            continue
        out.append(row)
    return out


def workloads(files: DataFrame) -> DataFrame:
    return extract(files, kubernetes, WORKLOADS, F.col("path").rlike(r"\.ya?ml$") & (F.octet_length("content") <= MAX_MANIFEST))


def topology_links(objects: DataFrame) -> DataFrame:
    """repo, namespace, from, to, kind: services to the workloads they select, ingresses to services, workloads to the hosts they name.

    Names count within their repository and namespace; a host may name another namespace after a dot.
    """
    from factloom.operators.joins import selected

    o = objects.where("error is null").withColumn("area", F.struct("repo", "namespace"))
    services = o.where("kind = 'Service'").select("area", F.col("name").alias("sid"), "selector")
    pods = o.where("kind in ('Deployment', 'StatefulSet', 'DaemonSet', 'Job', 'CronJob')").select("area", F.col("name").alias("oid"), "labels", "env")
    # ids hold the area, so that a service meets its own workloads only
    chosen = selected(services.withColumn("sid", F.struct("area", "sid")), pods.select("area", F.struct("area", "oid").alias("oid"), "labels"), "area")
    chosen = chosen.select(F.col("sid.area").alias("area"), F.col("sid.sid").alias("from"), F.col("oid.oid").alias("to"), F.lit("selects").alias("kind"))
    routed = o.where("kind = 'Ingress'").select("area", F.col("name").alias("from"), F.col("target").alias("to"), F.lit("routes").alias("kind")).join(services.select("area", F.col("sid").alias("to")), ["area", "to"], "left_semi")
    host = r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^@/]*@)?([A-Za-z0-9-]+)(?:\.([A-Za-z0-9-]+))?(?:[.:/]|$)"
    named = pods.select("area", F.col("oid").alias("from"), F.explode("env").alias("e")).select("area", "from", F.regexp_extract("e.value", host, 1).alias("host"), F.regexp_extract("e.value", host, 2).alias("space"))
    spaces = o.select("area").distinct()
    there = F.struct(F.col("area.repo").alias("repo"), F.when(F.col("space") == "", F.col("area.namespace")).otherwise(F.col("space")).alias("namespace"))
    asked = named.withColumn("there", there).join(spaces.select(F.col("area").alias("there"), F.lit(True).alias("known")), "there", "left")
    asked = asked.withColumn("there", F.when(F.col("known"), F.col("there")).otherwise(F.col("area")))  # a.b.c may also be a host of its own, or a port
    direct = asked.join(chosen.select(F.col("area").alias("there"), F.col("from").alias("host"), "to"), ["there", "host"]).where((F.col("from") != F.col("to")) | (F.col("there") != F.col("area")))
    every = chosen.select("area", "from", "to", "kind").unionByName(routed.select("area", "from", "to", "kind")).unionByName(direct.select("area", "from", "to", F.lit("calls").alias("kind"))).distinct()
    return every.select("area.repo", "area.namespace", "from", "to", "kind")
