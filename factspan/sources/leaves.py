"""Trees as tables: one row per scalar of a YAML, JSON, properties or XML file.

A small helper per format parses one file at a time inside Arrow batches; what the scalars mean is left to plans.  A
file that does not parse yields one row with an ``error`` and no value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_INTEGER = re.compile(r"[-+]?(0|[1-9][0-9]*)")
LEAVES = "scan_id string, path string, name string, scope string, doc int, seq int, segs array<string>, value string, line int, error string, profile string"


def yaml_leaves(text: str) -> Iterator[tuple[int, list[str], str | None]]:
    """(document, segments, scalar) depth first; list items have segments like ``[0]``; scalars stay as written, but
    numbers and booleans are canonical and nulls are None."""
    import yaml

    def walk(node, segs):
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                yield from walk(v, [*segs, str(k.value)])
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                yield from walk(v, [*segs, f"[{i}]"])
        else:
            yield segs, scalar(node)

    def scalar(node):
        v = node.value
        if node.style in ("'", '"', "|", ">"):
            return v
        if v in ("", "~") or v.lower() == "null":
            return None
        if v.lower() in ("true", "false"):
            return v.lower()
        return str(int(v)) if _INTEGER.fullmatch(v) else v

    for doc, root in enumerate(yaml.compose_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))):
        if root is not None:
            for segs, value in walk(root, []):
                yield doc, segs, value


_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def properties(text: str) -> dict[str, str]:
    """Pairs of a properties file: continuations, escapes, any of ``=``, ``:`` or space between; the last of a key stands."""
    lines, held = [], ""
    for raw in text.splitlines():
        line = held + raw.lstrip(" \t\f")
        if not held and line[:1] in ("#", "!"):
            continue
        tail = len(line) - len(line.rstrip("\\"))
        if tail % 2:
            held = line[:-1]
            continue
        held = ""
        if line:
            lines.append(line)
    if held:
        lines.append(held)

    def plain(s):
        return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), s)

    out = {}
    for line in lines:
        m = re.match(r"((?:\\.|[^\\=: \t\f])*)[ \t\f]*[=:]?[ \t\f]*(.*)", line, re.S)
        out[plain(m[1])] = plain(m[2])
    return out


def xml_values(text: str) -> Iterator[tuple[list[str], str]]:
    """(segments, value) of attributes (``@name``) and texts (``#``) of an XML file; document types are refused."""
    from xml.etree import ElementTree

    if re.search(r"<!(DOCTYPE|ENTITY)", text[:text.find(">", text.find("<!ENTITY")) + 1] if "<!ENTITY" in text else "") :
        raise ValueError("entities are not read")
    text = re.sub(r"<!DOCTYPE[^>\[]*>", "", text)

    def walk(node, segs):
        for k, v in node.attrib.items():
            yield [*segs, "@" + k.rpartition("}")[2]], v
        if node.text and node.text.strip():
            yield [*segs, "#"], node.text.strip()
        seen: dict[str, int] = {}
        for child in node:
            tag = str(child.tag).rpartition("}")[2]
            seen[tag] = seen.get(tag, -1) + 1
            yield from walk(child, [*segs, f"{tag}[{seen[tag]}]"])

    root = ElementTree.fromstring(text)
    yield from walk(root, [str(root.tag).rpartition("}")[2] + "[0]"])


def lines_of(lines: list[str], keys: list[str]) -> list[int | None]:
    """For every key, the first line that begins with the key or its last part and a separator.  The lines are gone
    through once."""
    wanted = {}
    for key in keys:
        last = (re.sub(r"\[\d+]$", "", key) if key[-1:] in ("]", "\n") else key).rpartition(".")[2]
        wanted[key] = (key + "=", key + ":", last + ":")
    heads = {h for hs in wanted.values() for h in hs}
    longest, first = max(map(len, heads), default=0), {}
    for i, line in enumerate(lines, 1):
        for sign in "=:":
            at = line.find(sign, 0, longest)
            while at >= 0:
                head = line[:at + 1]
                if head in heads and head not in first:
                    first[head] = i
                at = line.find(sign, at + 1, longest)
    return [min((first[h] for h in wanted[k] if h in first), default=None) for k in keys]


def dotted(segs: list[str]) -> str:
    return ".".join(segs).replace(".[", "[")


#: Keys that name the profile of their document, the first that is there; fixed values.
PROFILE_KEYS = ("spring.config.activate.on-profile", "spring.profiles")


def profiles(found: list[tuple[int, list[str], str | None]]) -> dict[int, str]:
    """The profile that each document of a file names, of those that name one."""
    named: dict[tuple[int, str], str] = {}
    for doc, segs, value in found:
        key = dotted(segs)
        if key in PROFILE_KEYS and value is not None:
            named[doc, key] = max(value, named.get((doc, key), value))
    return {doc: named[doc, key] for key in reversed(PROFILE_KEYS) for doc in {d for d, k in named if k == key}}


def leaves(files: DataFrame) -> DataFrame:
    """The scalars of YAML, properties and XML files among ``files``, each with the profile that its document names."""
    def of(scan_id, path, name, scope, file_type, content) -> list[tuple]:
        head, content = (scan_id, path, name, scope), content or ""
        try:
            if file_type == "YAML":
                found = list(yaml_leaves(content))
            elif file_type == "PROPERTIES":
                found = [(0, [k], v) for k, v in properties(content).items()]
            else:
                found = [(0, s, v) for s, v in xml_values(content)]
        except Exception as e:  # any fault of one file is that file's alone, and is reported
            return [(*head, 0, 0, [], None, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", None)]
        at = lines_of([x.strip() for x in content.splitlines()], [dotted(s) for _, s, _ in found]) if file_type != "XML" else [None] * len(found)
        of_document = profiles(found) if file_type != "XML" else {}
        return [(*head, d, i, s, v, line, None, of_document.get(d)) for i, ((d, s, v), line) in enumerate(zip(found, at))]

    names, kinds = zip(*(x.split() for x in LEAVES.split(", ")))
    types = [{"int": pa.int32(), "string": pa.string()}.get(k, pa.list_(pa.string())) for k in kinds]

    def run(batches):
        for b in batches:
            rows = [x for r in zip(*(c.to_pylist() for c in b.columns)) for x in of(*r)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=list(names))

    wanted = files.where("file_type in ('YAML', 'PROPERTIES', 'XML')")
    return wanted.select("scan_id", "path", "name", "scope", "file_type", "content").mapInArrow(run, LEAVES)
