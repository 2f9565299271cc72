"""Plug-in seams: what this process registers, then what installed packages declare as entry points."""

from __future__ import annotations

import logging
from importlib.metadata import entry_points

SEAMS = ("readers", "segmenters", "patchers", "embedders", "sinks", "slide_embedders", "multiplex_strategies")
_own: dict[str, dict[str, object]] = {seam: {} for seam in SEAMS}


def _seam(seam: str) -> dict[str, object]:
    if seam not in _own:
        raise KeyError(f"unknown seam {seam!r}; there are {', '.join(SEAMS)}")
    return _own[seam]


def register(seam: str, name: str):
    """A decorator that puts a class or function under a name; it comes before an entry point of that name."""

    def put(thing: object) -> object:
        _seam(seam)[name] = thing
        return thing

    return put


def _declared(seam: str) -> dict[str, object]:
    found: dict[str, object] = {}
    for point in entry_points(group=f"tissuelake.{seam}"):
        try:
            found[point.name] = point.load()
        except Exception as e:  # noqa: BLE001 - a broken plug-in must not break the others
            logging.getLogger(__name__).warning("plug-in %s can't be loaded: %s", point.name, e)
    return found


def available(seam: str) -> list[str]:
    return sorted({*_seam(seam), *_declared(seam)})


def get(seam: str, name: str) -> object:
    own = _seam(seam)
    if name in own:
        return own[name]
    declared = _declared(seam)
    if name not in declared:
        raise KeyError(f"no {name!r} in {seam}; there are {', '.join(available(seam))}")
    return declared[name]


def _built_in() -> None:
    from tissuelake.operators import embed, pooling, segment, tiling
    from tissuelake.sources.omezarr import OmeZarr
    from tissuelake.sources.store import Store

    for seam, things in {"readers": {"omezarr": OmeZarr}, "segmenters": segment.SEGMENTERS | {"nuclear": segment.nuclear_mask}, "patchers": {"grid": tiling.kept}, "embedders": {"mean": embed.MeanEmbedder, "histogram": embed.HistogramEmbedder, "projection": embed.ProjectionEmbedder}, "sinks": {"parquet": Store}, "slide_embedders": {"mean": pooling.mean_pool, "max": pooling.max_pool, "meanmax": pooling.meanmax_pool, "gated": pooling.gated_attention_pool, "multihead": pooling.multihead_pool}}.items():
        for name, thing in things.items():
            _own[seam].setdefault(name, thing)
    from tissuelake.operators.multiplex import embed_markers

    _own["multiplex_strategies"].setdefault("channelwise", embed_markers)


_built_in()
