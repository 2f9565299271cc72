"""Identities of channels and markers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marker synonyms and nuclear stains.
MARKER_SYNONYMS = {"PANCYTOKERATIN": "CYTOKERATIN", "PANCK": "CYTOKERATIN", "CK": "CYTOKERATIN", "GRANZYMEB": "GZMB", "GRANZYMEA": "GZMA", "CLA": "CD162", "PSGL1": "CD162"}
NUCLEAR = ("dapi", "hoechst", "hochst", "dna")


@F.pandas_udf(T.StringType())
def identity(names: pd.Series) -> pd.Series:
    """Names that mean the same channel become equal: compatibility form, trimmed, case folded."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).strip().casefold())


def nuclear_kind(name: Column) -> Column:
    """Which nuclear stain an identity names, if any: dapi, hoechst, dna, or dna-numbered for DNA1 and DNA2."""
    bounded = lambda s: rf"(?<![a-z]){s}(?![a-z])"
    return (
        F.when(name.rlike(bounded("dapi")), "dapi")
        .when(name.rlike(bounded("hoechst")) | name.rlike(bounded("hochst")), "hoechst")
        .when(name == "dna", "dna")
        .when(name.rlike(r"(?<![a-z0-9])dna[ _-]?[12](?![a-z0-9])"), "dna-numbered")
    )


def marker_name(name: Column) -> Column:
    """A channel's name as marker vocabularies write it; null for blank and empty cycles."""
    low = F.lower(F.trim(name))
    return F.when(low.rlike("^(hoechst|hochst|dapi)"), "DAPI").when(low.rlike("^(blank|empty)"), None).otherwise(F.regexp_replace(F.upper(F.trim(name)), "[_\\- ]", ""))


def marker_candidates(marker: Column) -> Column:
    """Vocabulary entries to try for a marker, in order: itself, its synonym, the CD tokens in it."""
    synonyms = F.create_map(*(F.lit(x) for pair in MARKER_SYNONYMS.items() for x in pair))
    return F.filter(F.concat(F.array(marker, F.try_element_at(synonyms, marker)), F.regexp_extract_all(marker, F.lit(r"(CD\d+[A-Z]*)"), F.lit(1))), lambda x: x.isNotNull() & (x != ""))
