"""Identities of sources, grids and tiles, and credentials kept out of them."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
from urllib.parse import unquote, unquote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuelake.functions.numerics import general

SUFFIXES = (".embeddings.zarr", ".ome.zarr", ".zarr")
LONGEST = 160

# Query keys that carry credentials, by provider.
SECRET_KEYS = frozenset(
    "access-token access_token api-key api_key apikey auth authorization awsaccesskeyid bearer_token client_secret credential googleaccessid hf-token hf_token id_token key-pair-id oauth_token password passwd refresh_token sas_token secret security-token shared_access_signature sig signature subscription-key token x-api-key".split()
)
SAS_KEYS = frozenset("epk erk saoid scid sdd se ses si sig sip skdutid skoid sks skt sktid ske skv sp spk spr sr srh srk srq srt ss st suoid sv".split())
SAS_HOSTS = tuple(f".{kind}.core.windows.net" for kind in ("blob", "dfs", "file", "queue", "table"))
SIGNED = {"awsaccesskeyid": frozenset("awsaccesskeyid expires security-token signature".split()), "googleaccessid": frozenset("expires googleaccessid signature".split()), "key-pair-id": frozenset("expires key-pair-id policy signature".split())}

_PLAIN = frozenset(re.sub("[-_]", "", k) for k in SECRET_KEYS)
_URI = r"[A-Za-z][A-Za-z0-9+.-]*://"


def is_qualified(source: Column) -> Column:
    return source.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")


def is_remote(source: Column) -> Column:
    return is_qualified(source) & ~F.lower(source).startswith("file://")


def _kept(raw: str, host: str | None) -> str:
    """A query or query-shaped fragment without its secret fields; what stays keeps its bytes and separators."""
    pieces = re.split("([&;])", raw)
    fields, between = pieces[::2], pieces[1::2]
    keys = [unquote_plus(f.partition("=")[0]).casefold() for f in fields]
    have = set(keys)
    families = [v for k, v in SIGNED.items() if "signature" in have and k in have]
    if (host is not None and host.endswith(SAS_HOSTS)) or ("sig" in have and have & (SAS_KEYS - {"sig"})):
        families.append(SAS_KEYS)
    stay = [i for i, k in enumerate(keys) if not (k.startswith(("x-amz-", "x-goog-")) or k in SECRET_KEYS or re.sub("[-_]", "", k) in _PLAIN or any(k in f for f in families))]
    return "".join((between[i - 1] if n else "") + fields[i] for n, i in enumerate(stay))


def without_credentials(uri: str) -> str:
    """A qualified URI without user information and secret fields; others come back byte for byte."""
    parts = urlsplit(uri)
    if parts.scheme.casefold() == "file":
        return uri
    query = _kept(parts.query, (parts.hostname or "").casefold()) if parts.query else ""
    fragment = _kept(parts.fragment, None) if "=" in parts.fragment else parts.fragment
    if "@" not in parts.netloc and query == parts.query and fragment == parts.fragment:
        return uri
    return urlunsplit((uri.partition(":")[0], parts.netloc.rpartition("@")[2], parts.path, query, fragment))


def source_uri_of(source: str) -> str:
    """What provenance records of a source: local paths as absolute file URIs, remote ones without credentials."""
    if re.match(_URI, source):
        return source if source[:7].lower() == "file://" else without_credentials(source)
    return f"file://{os.path.abspath(source)}"


@F.pandas_udf(T.StringType())
def source_uri(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else source_uri_of(s))


def _bare(uri: re.Match[str]) -> str:
    text, tail = uri[0], ""
    while text and (text[-1] in ".,;!?'" or any(text[-1] == c and text.count(c) > text.count(o) for o, c in ("()", "[]", "{}"))):
        text, tail = text[:-1], text[-1] + tail
    try:
        return without_credentials(text) + tail
    except ValueError:
        return "<redacted-uri>" + tail


def redacted(text: str) -> str:
    """Free text with credentials taken out of its URIs: outer ones first, then those nested in them."""
    text = re.sub(_URI + r"[^\s\"<>`]+", _bare, text)
    return re.sub(_URI + rf"(?:(?!{_URI})[^\s\"<>`])+", _bare, text)


@F.pandas_udf(T.StringType())
def redact_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else redacted(s))


def redacted_value(value: object, by_key: bool = True) -> object:
    """Nested metadata with credentials taken out of every URI and, with by_key, of values under secret keys."""
    if isinstance(value, dict):
        return {str(k): "<redacted>" if by_key and re.sub("[-_]", "", str(k)).casefold() in _PLAIN else redacted_value(v, by_key) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redacted_value(v, by_key) for v in value]
    return redacted(value) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else json.dumps(redacted_value(json.loads(s)), sort_keys=True))


def without_suffix(name: str, fold: bool) -> str:
    known = name.lower() if fold else name
    return next((name[: -len(s)] for s in SUFFIXES if known.endswith(s)), name)


def slide_id_of(source: str) -> str:
    """Readable identity of a slide: a local file's name; of remote sources and numbered images also a digest."""
    qualified = re.match(_URI, source) is not None
    remote = qualified and source[:7].lower() != "file://"
    named = source_uri_of(source) if qualified else source
    path = urlsplit(named).path if qualified else named
    path = path if remote or not qualified else unquote(path)
    parts = [p for p in path.rstrip("/").split("/") if p]
    numbered = len(parts) > 1 and parts[-1].isdigit() and (remote or parts[-2].lower().endswith(SUFFIXES))
    if not remote and not numbered:
        return without_suffix(os.path.basename(path.rstrip("/")), fold=False)
    name = parts[-2] if numbered else parts[-1] if parts else urlsplit(named).netloc or "slide"
    name = re.sub("[^A-Za-z0-9._-]+", "-", without_suffix(unquote(name), fold=True)).strip("._-")[:LONGEST].rstrip("._-") or "slide"
    key = named if qualified else os.path.abspath(named.rstrip("/"))
    return f"{name}-{hashlib.sha256(key.encode()).hexdigest()[:16]}"


@F.pandas_udf(T.StringType())
def slide_id(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else slide_id_of(s))


def remote_slide_id(uri: Column) -> Column:
    """slide_id() of credential-free remote URIs whose last path part is plain, in expressions alone."""
    path = F.regexp_replace(F.regexp_replace(uri, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    name = F.when(F.size(parts) == 0, F.regexp_extract(uri, "://([^/?#]*)", 1)).when((F.size(parts) > 1) & last.rlike("^[0-9]+$"), before).otherwise(last)
    safe = F.regexp_replace(F.regexp_replace(name, r"(?i)(\.embeddings\.zarr|\.ome\.zarr|\.zarr)$", ""), "[^A-Za-z0-9._-]+", "-")
    safe = F.regexp_replace(F.substring(F.regexp_replace(safe, "^[._-]+|[._-]+$", ""), 1, LONGEST), "[._-]+$", "")
    return F.concat_ws("-", F.when(safe == "", "slide").otherwise(safe), F.substring(F.sha2(uri, 256), 1, 16))


def join_path(uri: str, *children: str) -> str:
    """Path parts appended before a URI's query."""
    if not re.match(_URI, uri):
        return os.path.join(uri, *children) if children else uri
    parts = urlsplit(uri)
    path = parts.path
    for c in children:
        path = posixpath.join(path, c.lstrip("/"))
    return urlunsplit(parts._replace(path=path)) if children else uri


def canonical_json(value: object, ascii_only: bool = False) -> str:
    """One text for equal values: sorted keys, no spaces, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def config_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint(payload: dict) -> dict:
    """A record of what made an output; its digest tells equal outputs."""
    return {"version": 1, "algorithm": "sha256", "digest": hashlib.sha256(canonical_json(payload).encode()).hexdigest(), "payload": payload}


def grid_key(mpp: Column, patch_px: Column) -> Column:
    return F.concat(F.lit("mpp"), general(mpp), F.lit("_px"), patch_px.cast("string"))


def tile_id(x: Column, y: Column, width: Column) -> Column:
    """Equal-width identity of a tile; width: digits of the largest coordinate."""
    pad = lambda c: F.lpad(c.cast("string"), width, "0")
    return F.concat_ws("_", pad(x), pad(y))
