"""IRIs: splitting and prefixes as column expressions, resolution by RFC 3986."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Well-known prefixes.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "schema": "https://schema.org/", "foaf": "http://xmlns.com/foaf/0.1/", "dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/", "skos": "http://www.w3.org/2004/02/skos/core#",
    "vcard": "http://www.w3.org/2006/vcard/ns#", "acl": "http://www.w3.org/ns/auth/acl#", "ldp": "http://www.w3.org/ns/ldp#", "solid": "http://www.w3.org/ns/solid/terms#",
}
_PARTS = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.DOTALL)
LOCAL = r"^[A-Za-z0-9_À-\x{10FFFF}]([A-Za-z0-9_À-\x{10FFFF}.-]*[A-Za-z0-9_À-\x{10FFFF}-])?$"


def namespace(iri: Column) -> Column:
    """Up to the last ``#``, else the last ``/``, if what follows is a local name; else the whole."""
    return F.when(local_name(iri) == "", iri).otherwise(F.substring(iri, F.lit(1), F.length(iri) - F.length(local_name(iri))))


def local_name(iri: Column) -> Column:
    rest = F.regexp_extract(iri, r"[/#]([^/#]*)$", 1)
    return F.when(rest.rlike(LOCAL), rest).otherwise("")


def compact(iri: Column, prefixes: dict[str, str] | None = None) -> Column:
    """``prefix:local`` by the longest known namespace, else the IRI itself."""
    out = iri
    for prefix, ns in sorted((prefixes or PREFIXES).items(), key=lambda x: (len(x[1]), x[0])):
        rest = F.substring(iri, F.lit(len(ns) + 1), F.length(iri))
        out = F.when(iri.startswith(ns) & ((rest == "") | rest.rlike(LOCAL)), F.concat(F.lit(prefix + ":"), rest)).otherwise(out)
    return out


def prefix_from(namespace_: str, taken: dict[str, str]) -> str:
    """A prefix for a namespace: the known one, else made of its last telling word, numbered if that is taken."""
    for prefix, ns in taken.items():
        if ns == namespace_:
            return prefix
    host, _, path = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", namespace_).rstrip("/#").partition("/")
    words = [w for w in re.split(r"[/#]", path) if re.fullmatch(r"[A-Za-z][A-Za-z_-]*", w) and w.lower() not in ("ns", "core", "terms", "vocab", "schema", "ontology", "v")]
    names = [w for w in host.split(".") if re.fullmatch(r"[A-Za-z][A-Za-z-]*", w) and w not in ("www", "com", "org", "net", "purl")]
    stem = re.sub(r"[^a-z]", "", (words[-1] if words else names[0] if names else "ns").lower())[:12] or "ns"
    if stem != "ns" and stem not in taken:
        return stem
    return next(f"{stem}{i}" for i in range(1, len(taken) + 2) if f"{stem}{i}" not in taken)


def prefixes_for(q: DataFrame, known: dict[str, str] | None = None, most: int = 1000) -> dict[str, str]:
    """Prefixes for the namespaces of predicates, classes and datatypes in use: the known ones, and made ones for the rest.

    The ``most`` used namespaces get one; what is left is written in full.
    """
    known = PREFIXES if known is None else known
    named = F.array("p", F.when((F.col("p") == PREFIXES["rdf"] + "type") & (F.col("o_kind") == 0), F.col("o")), F.when(F.col("o_kind") == 2, F.col("o_dt")))
    used = q.select(F.explode(F.array_compact(named)).alias("iri")).where(local_name(F.col("iri")) != "").groupBy(namespace(F.col("iri")).alias("ns")).agg(F.count("*").alias("n"))
    out, taken = {}, dict(known)
    for r in sorted(r.ns for r in used.orderBy(F.desc("n"), "ns").limit(most).collect()):
        prefix = prefix_from(r, taken)
        out[prefix] = taken[prefix] = r
    return out


def compact_parts(iri: Column, prefixes: dict[str, str], role: str = "subject", base: str | None = None) -> Column:
    """struct(kind, prefix, text): how an IRI is written in its role.

    ``special`` (rdf:type as a predicate is ``a``), ``prefixed`` (the longest
    known namespace), ``relative`` (below ``base``; subjects and objects only),
    else ``full``.
    """
    part = lambda kind, prefix, text: F.struct(F.lit(kind).alias("kind"), prefix.cast("string").alias("prefix"), text.alias("text"))
    name = compact(iri, prefixes)
    out = F.when(name != iri, part("prefixed", F.substring_index(name, ":", 1), F.substring(name, F.instr(name, ":") + 1, F.length(name))))
    if base and role in ("subject", "object"):
        rest = F.substring(iri, F.lit(len(base) + 1), F.length(iri))
        out = out.when(iri.startswith(base) & ~rest.rlike("^/|:"), part("relative", F.lit(None), rest))
    if role == "predicate":
        out = F.when(iri == PREFIXES["rdf"] + "type", part("special", F.lit(None), F.lit("a"))).otherwise(out.otherwise(part("full", F.lit(None), iri)))
        return out
    return out.otherwise(part("full", F.lit(None), iri))


def expand(name: Column, prefixes: dict[str, str] | None = None) -> Column:
    """The IRI of ``prefix:local``; names of no known prefix stay."""
    table = F.create_map(*[F.lit(x) for pair in (prefixes or PREFIXES).items() for x in pair])
    ns = table[F.substring_index(name, ":", 1)]
    return F.when(ns.isNotNull() & name.contains(":"), F.concat(ns, F.substring(name, F.instr(name, ":") + 1, F.length(name)))).otherwise(name)


def template_pattern(template: str) -> tuple[str, list[str]]:
    """Anchored pattern of an IRI template and its variables: ``{v}`` within a segment, ``{+v}`` across."""
    names, out, at = [], "", 0
    for m in re.finditer(r"\{(\+?)(\w+)\}", template):
        out += re.escape(template[at : m.start()]).replace("/", "/") + ("(.*)" if m[1] else "([^/]*)")
        names.append(m[2])
        at = m.end()
    return "^" + out + re.escape(template[at:]) + "$", names


def from_template(iri: Column, template: str) -> dict[str, Column]:
    """A column per variable, null where the IRI doesn't match."""
    pattern, names = template_pattern(template)
    return {n: F.when(iri.rlike(pattern), F.regexp_extract(iri, pattern, i + 1)) for i, n in enumerate(names)}


def last_path_element(iri: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(iri, "[?#].*$", ""), r"([^/]*)/?$", 1)


def fragment(iri: Column) -> Column:
    return F.when(iri.contains("#"), F.substring(iri, F.instr(iri, "#") + 1, F.length(iri)))


def _parts(iri: str) -> list[str | None]:
    return list(_PARTS.match(iri).groups())


def _remove_dots(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "..":
            if len(out) > 1 or (out and out[0] != ""):
                out.pop()
            if last:
                out.append("")
        elif segment == ".":
            if last:
                out.append("")
        else:
            out.append(segment)
    joined = "/".join(out)
    return "/" + joined if path.startswith("/") and not joined.startswith("/") else joined


def _join(scheme: str | None, authority: str | None, path: str, query: str | None, frag: str | None) -> str:
    return (f"{scheme}:" if scheme is not None else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{frag}" if frag is not None else "")


def resolve_one(iri: str, base: str | None) -> str:
    """Reference resolution; an absolute IRI is returned as it is."""
    scheme, authority, path, query, frag = _parts(iri)
    if scheme is not None:
        return iri
    if base is None or _parts(base)[0] is None:
        raise ValueError(f"a relative IRI needs a base: {iri!r}")
    b_scheme, b_authority, b_path, b_query, _ = _parts(base)
    if authority is not None:
        return _join(b_scheme, authority, _remove_dots(path), query, frag)
    if path == "":
        return _join(b_scheme, b_authority, b_path, query if query is not None else b_query, frag)
    if path.startswith("/"):
        path = _remove_dots(path)
    elif b_authority is not None and b_path == "":
        path = _remove_dots("/" + path)
    else:
        path = _remove_dots(b_path[: b_path.rfind("/") + 1] + path)
    return _join(b_scheme, b_authority, path, query, frag)


def relativize_one(iri: str, base: str | None, max_up: int = 2) -> str:
    """The shortest reference that resolves back to the IRI, or the IRI itself."""
    if not base:
        return iri
    a, b = _parts(iri), _parts(base)
    if a[0] != b[0] or a[1] != b[1]:
        return iri
    tail = _join(None, None, "", a[3], a[4])
    tries = []
    if iri == base:
        tries.append("")
    if a[2] == b[2]:
        tries.append(_join(None, None, "", a[3] if a[3] != b[3] else None, a[4]))
    folder = b[2][: b[2].rfind("/") + 1]
    up = 0
    while folder and up <= max_up:
        if a[2].startswith(folder):
            rest = "../" * up + a[2][len(folder) :]
            tries.append((rest or "./") + tail)
            break
        folder, up = folder[: folder[:-1].rfind("/") + 1], up + 1
    tries.append(a[2] + tail)
    fit = [t for t in tries if len(t) < len(iri) and not re.match(r"[^/?#]*:", t) and not t.startswith("//") and resolve_one(t, base) == iri]
    return min(fit, key=len, default=iri)


def resolve(iri: Column, base: Column) -> Column:
    """Vectors of IRIs against vectors of bases; null where that can't be."""

    def run(i: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            try:
                return None if x is None else resolve_one(x, y)
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(i, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(iri, base)


def relativize(iri: Column, base: Column) -> Column:
    def run(i: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else relativize_one(x, y) for x, y in zip(i, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(iri, base)
