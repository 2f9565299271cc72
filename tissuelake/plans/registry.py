"""Models and the geometries that they are extracted at."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: For models that name no scale or size.
DEFAULT_MPP, DEFAULT_PX = 1.0, 224
COLUMNS = "model string, family string, dim int, input_size int, recommended_mpp double, recommended_px int, pooling string, amp string, modality string"


@dataclass(frozen=True)
class Model:
    name: str
    dim: int
    input_size: int = DEFAULT_PX
    mpp: float | None = None
    patch_px: int | None = None
    family: str = "built-in"
    pooling: str = "pooled"
    amp: str = "fp32"
    modality: str = "rgb"
    gated: bool = False

    @property
    def px(self) -> int:
        return self.patch_px or self.input_size


@dataclass(frozen=True)
class SlideModel:
    """A slide encoder: pooling without weights, or attention with the caller's; requires names its patch model or any."""

    name: str
    requires: str = "any"
    dim: int | None = None
    pooling: str = "mean"
    patch_dim: int | None = None
    gated: bool = False


# Published patch models (name, family, dim, input pixels, extracted pixels, pooling, micrometres a pixel,
# precision, modality, whether access is asked for; - where nothing is recommended) and slide encoders (name, family,
# dim, required patch model and its dim; -1: as the patch model has it). Their weights aren't here: a plug-in embeds.
_PUBLISHED = """
resnet50 torchvision 2048 224 224 pooled - - brightfield no
dinov2 timm 1024 224 224 cls - - brightfield no
uni timm 1024 224 224 cls 0.5 - brightfield yes
uni2_h timm 1536 224 224 cls 0.5 - brightfield yes
path_orchestra timm 1024 224 224 cls 0.5 - brightfield yes
virchow2 timm 2560 224 224 cls_concat_meanpatch 0.5 fp16 brightfield yes
virchow timm 2560 224 224 cls_concat_meanpatch 0.5 fp16 brightfield yes
gigapath timm 1536 224 256 cls 0.5 fp16 brightfield yes
gigapath_flash timm 384 224 256 cls 0.5 fp16 brightfield yes
conch conch 512 448 448 pooled 0.5 fp32 brightfield yes
conch_v1_5 conch_v1_5 768 448 512 pooled 0.5 fp16 brightfield yes
h_optimus_0 timm 1536 224 224 cls 0.5 fp16 brightfield yes
h0_mini timm 768 224 224 cls 0.5 fp16 brightfield yes
h_optimus_1 timm 1536 224 224 cls 0.5 fp16 brightfield yes
gpfm timm 1024 224 224 cls 0.5 fp32 brightfield no
midnight transformers 3072 224 224 cls_concat_meanpatch 0.5 fp32 brightfield no
openmidnight dino_teacher 1536 224 224 cls - fp32 brightfield yes
openpath dino_teacher 1536 224 224 cls 0.5 fp32 brightfield no
phikon transformers 768 224 224 cls 0.5 fp32 brightfield no
phikon_v2 transformers 1024 224 224 cls 0.5 fp32 brightfield no
lunit_dino timm 384 224 224 cls 0.5 fp32 brightfield no
lunit_dino8 timm 384 224 224 cls 0.5 fp32 brightfield no
lunit_bt timm 2048 224 224 pooled 0.5 fp32 brightfield no
lunit_mocov2 timm 2048 224 224 pooled 0.5 fp32 brightfield no
lunit_swav timm 2048 224 224 pooled 0.5 fp32 brightfield no
sp22m timm 384 224 224 cls 0.5 fp32 brightfield no
retccl timm 2048 256 256 pooled 1 fp32 brightfield no
hipt timm 384 256 256 cls 0.5 fp32 brightfield no
mstar timm 1024 224 224 cls 0.5 fp32 brightfield yes
kaiko_vitl timm 1024 224 224 cls 0.5 fp32 brightfield no
ctranspath timm 768 224 224 pooled 0.5 fp32 brightfield no
hibou_l transformers 1024 224 224 cls 0.5 fp32 brightfield yes
hibou_b transformers 768 224 224 cls 0.5 fp32 brightfield yes
kronos kronos 384 224 224 pooled - - multiplex yes
musk musk 1024 384 384 cls 0.5 fp16 brightfield yes
quiltnet open_clip 512 224 224 pooled 0.5 fp32 brightfield no
biomedclip open_clip 512 224 224 pooled 0.5 fp32 brightfield no
plip clip_hf 512 224 224 pooled 0.5 fp32 brightfield no
seal_conch seal 512 224 224 pooled 0.5 fp32 brightfield yes
seal_univ2 seal 1536 224 224 pooled 0.5 fp32 brightfield yes
keep keep 768 224 224 pooled - fp32 brightfield no
"""
_PUBLISHED_SLIDE = """
mean pool -1 any -1 no
max pool -1 any -1 no
meanmax pool -1 any -1 no
titan titan 768 conch_v1_5 768 yes
prism prism 1280 virchow 2560 yes
feather_conch_v15 feather 512 conch_v1_5 768 yes
feather_uni_v2 feather 512 uni2_h 1536 yes
feather_uni feather 512 uni 1024 yes
madeleine madeleine 512 conch 512 yes
gigapath_slide gigapath_slide 768 gigapath 1536 yes
gigapath_flash_slide gigapath_slide 384 gigapath_flash 384 yes
chief chief 768 ctranspath 768 no
tangle tangle 512 uni 1024 no
"""


def _published() -> dict[str, Model]:
    out = {}
    for line in _PUBLISHED.split("\n")[1:-1]:
        name, family, dim, size, px, pooling, mpp, amp, modality, gated = line.split()
        known = lambda v: None if v == "-" else v
        out[name] = Model(name, int(dim), int(size), None if mpp == "-" else float(mpp), int(px) if px != size else None, family, pooling, known(amp) or "fp32", modality, gated == "yes")
    return out


def _published_slide() -> dict[str, SlideModel]:
    out = {}
    for line in _PUBLISHED_SLIDE.split("\n")[1:-1]:
        name, family, dim, needs, patch_dim, gated = line.split()
        out[name] = SlideModel(name, needs, None if dim == "-1" else int(dim), name if family == "pool" else family, None if patch_dim == "-1" else int(patch_dim), gated == "yes")
    return out


BUILT_IN = {m.name: m for m in (Model("mean", 8, 64), Model("histogram", 24, 64), Model("projection", 32, 64, 0.5))}
SLIDE_MODELS = {m.name: m for m in (SlideModel("mean"), SlideModel("max", pooling="max"), SlideModel("meanmax", pooling="meanmax"), SlideModel("gated", pooling="gated"), SlideModel("multihead", pooling="multihead"))}


PUBLISHED, PUBLISHED_SLIDE = _published(), _published_slide()


@dataclass(frozen=True)
class Geometry:
    """Models that share one extraction at a scale and patch size, and how it was chosen."""

    mpp: float
    patch_px: int
    models: tuple[str, ...]
    source: str


def read_registry(path: str) -> dict[str, Model]:
    """Models of a YAML registry: entries by name with embedding_dim, input_size, recommended_mpp and so on."""
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f)
    return {k: Model(k, e["embedding_dim"], e.get("input_size", DEFAULT_PX), e.get("recommended_mpp"), e.get("recommended_patch_px"), e.get("family", ""), e.get("pooling", "pooled"), e.get("inference_amp", "fp32"), e.get("modality", "rgb")) for k, e in data.items() if "embedding_dim" in e}


def as_table(spark: SparkSession, catalog: Mapping[str, Model]) -> DataFrame:
    return spark.createDataFrame([(m.name, m.family, m.dim, m.input_size, m.mpp, m.patch_px, m.pooling, m.amp, m.modality) for m in catalog.values()], COLUMNS)


def json_object(text: str) -> dict:
    """A JSON object with finite numbers only, as options of models come on the command line."""
    import json

    def refuse(name: str) -> float:
        raise ValueError(f"{name} is not a finite number")

    found = json.loads(text, parse_constant=refuse)
    if not isinstance(found, dict):
        raise ValueError("a JSON object is needed")
    return found


def grouped_geometries(models: DataFrame) -> DataFrame:
    """mpp, patch_px and models (in order of pos) of a table of pos, model, mpp, patch_px and input_size.

    A registry's table: as many rows as there are models.
    """
    from pyspark.sql import functions as F

    sized = models.select("pos", "model", F.coalesce("mpp", F.lit(DEFAULT_MPP)).alias("mpp"), F.coalesce("patch_px", "input_size").alias("patch_px"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "model"))), lambda m: m["model"])
    return sized.groupBy("mpp", "patch_px").agg(ordered.alias("models"))


def with_specs(rows: DataFrame, catalog: Mapping[str, Model]) -> DataFrame:
    """rows (with model) joined to their models' metadata; an unknown model is an error."""
    from pyspark.sql import functions as F

    specs = as_table(rows.sparkSession, catalog).withColumn("known_", F.lit(True))
    joined = rows.join(F.broadcast(specs), "model", "left")  # a registry's few rows
    error = F.raise_error(F.concat(F.lit("unknown model "), "model")).cast("int")
    return joined.withColumn("dim", F.when(F.col("known_"), F.col("dim")).otherwise(error)).drop("known_")


def _number(x: float, what: str) -> float:
    if isinstance(x, bool) or not math.isfinite(x) or x <= 0:
        raise ValueError(f"{what} must be finite and over zero")
    return float(x)


def known(models: list[str], catalog: Mapping[str, Model]) -> None:
    if missing := sorted(set(models) - set(catalog)):
        raise ValueError(f"unknown models {', '.join(missing)}; known are {', '.join(sorted(catalog))}")


def shared_mpp(models: list[str], requested: float | None, catalog: Mapping[str, Model]) -> tuple[float, str]:
    """One scale for all models and its source; models that recommend different ones are an error."""
    known(models, catalog)
    if requested is not None:
        return _number(requested, "mpp"), "explicit"
    wanted = {catalog[m].mpp for m in models if catalog[m].mpp}
    if len(wanted) > 1:
        raise ValueError(f"the models recommend different scales {sorted(wanted)}; give one")
    return (wanted.pop(), "auto") if wanted else (DEFAULT_MPP, "auto-default")


def geometries(models: list[str], mpp: float | None = None, patch_px: int | None = None, plan: list[dict] | None = None, catalog: Mapping[str, Model] = BUILT_IN) -> list[Geometry]:
    """The extractions that a request needs, in first-seen order; models of equal geometry share one.

    A plan gives each entry's geometry. A scale and a size together hold for all models. A scale alone keeps each
    model's size; a size alone needs one shared scale. Otherwise each model has its own.
    """
    known([e["model"] for e in plan] if plan is not None else models, catalog)
    wanted: list[tuple[float, int, str, str]] = []
    if plan is not None:
        for e in plan:
            m = catalog[e["model"]]
            wanted.append((_number(e.get("mpp", m.mpp or DEFAULT_MPP), "mpp"), int(_number(e.get("patch_px", m.px), "patch_px")), m.name, "config"))
    elif patch_px is not None:
        one = shared_mpp(models, mpp, catalog)[0]
        wanted = [(one, int(_number(patch_px, "patch_px")), m, "explicit") for m in models]
    elif mpp is not None:
        wanted = [(_number(mpp, "mpp"), catalog[m].px, m, "explicit") for m in models]
    else:
        wanted = [(catalog[m].mpp or DEFAULT_MPP, catalog[m].px, m, "recommended" if catalog[m].mpp else "default") for m in models]
    groups: dict[tuple[float, int], tuple[dict[str, None], str]] = {}
    for scale, px, model, source in wanted:
        groups.setdefault((scale, px), ({}, source))[0][model] = None
    return [Geometry(scale, px, tuple(names), source) for (scale, px), (names, source) in groups.items()]


def patch_model_for(encoder: SlideModel, available: list[str]) -> str:
    """The patch model whose features an encoder takes; with several to choose from, an error."""
    fit = [m for m in available if encoder.requires in ("any", m)]
    if len(fit) != 1:
        raise ValueError(f"{encoder.name} needs one of the patch models, found {fit or 'none'}")
    return fit[0]


def precision(requested: str, device: str) -> str:
    """Half precisions count on accelerators only."""
    return "fp32" if device in ("cpu", "mps") and requested in ("fp16", "bf16", "auto") else requested
