"""Faults of a nested warm-up profile: a table of rules over the paths of a VARIANT, each fault with its path and reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import let

FAULT = "struct<path:string,reason:string>"
# fixed values: the stages of a profile, the fields of their graphs, and the granule of lengths
STAGES = {"text_encoder": ("batch_size", "token_length"), "backbone_prefill": ("branch_batch_size", "sequence_length"), "backbone_decode": ("branch_batch_size",), "depth_decoder": ("batch_size",), "codec": ("num_lanes", "chunk_frames")}
GRANULE = 32
LENGTHS = ("token_length", "sequence_length")


def _is(doc: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), F.lit(kind)), F.lit(False))


def _number(doc: Column, path: str) -> Column:
    """A number, or a text that is one, without its fraction."""
    return F.coalesce(F.try_variant_get(doc, path, "double"), F.try_variant_get(doc, path, "string").try_cast("double")).cast("long")


def _fault(when: Column, path: Column | str, reason: str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(when, F.struct(path.alias("path"), F.lit(reason).alias("reason")).cast(FAULT))


def _scales(doc: Column) -> Column:
    return F.try_variant_get(doc, "$.service.cfg_scales", "array<double>")


def _branches(doc: Column) -> Column:
    """Batches that the scales need: one branch for a scale of 1, two for more; null without scales."""
    needed = F.array_sort(F.array_distinct(F.transform(_scales(doc), lambda s: F.when(s == 1, F.lit(1).cast("long")).otherwise(2))))
    return F.when(F.size(needed) > 0, needed)


def _graphs(doc: Column, stage: str) -> Column:
    return F.try_variant_get(doc, f"$.stages.{stage}.graphs", "array<variant>")


def _batches(doc: Column, stage: str) -> Column:
    field = next(f for f in STAGES[stage] if f.endswith("batch_size"))
    return F.array_sort(F.array_distinct(F.transform(_graphs(doc, stage), lambda g: _number(g, f"$.{field}"))))


#: (path, condition of a fault, reason) of the rules on single places, in the order in which they are told.
PLACES: tuple[tuple[str, Callable[[Column], Column], str], ...] = (
    ("$.schema_version", lambda d: ~F.coalesce(_number(d, "$.schema_version") == 1, F.lit(False)), "must be 1"),
    ("$.name", lambda d: F.trim(F.coalesce(F.try_variant_get(d, "$.name", "string"), F.lit(""))) == "", "must not be empty"),
    ("$.service", lambda d: ~_is(d, "$.service", "OBJECT"), "must be an object"),
    ("$.service.concurrency", lambda d: _is(d, "$.service", "OBJECT") & ~F.coalesce(_number(d, "$.service.concurrency") > 0, F.lit(False)), "must be > 0"),
    ("$.service.concurrency", lambda d: F.coalesce(_number(d, "$.service.concurrency") > 1, F.lit(False)), "must be 1"),
    ("$.service.cfg_scales", lambda d: _is(d, "$.service", "OBJECT") & ~(_is(d, "$.service.cfg_scales", "ARRAY") & (F.coalesce(F.size(_scales(d)), F.lit(0)) > 0)), "must be a non-empty list"),
    ("$.service.cfg_scales", lambda d: F.coalesce(F.exists(_scales(d), lambda s: s < 1), F.lit(False)), "must be >= 1"),
    ("$.stages", lambda d: ~_is(d, "$.stages", "OBJECT"), "must be an object"),
    ("$.warmup_request", lambda d: ~_is(d, "$.warmup_request", "OBJECT"), "must be an object"),
    *[(f"$.warmup_request.{f}", lambda d, f=f: _is(d, "$.warmup_request", "OBJECT") & (F.trim(F.coalesce(F.try_variant_get(d, f"$.warmup_request.{f}", "string"), F.lit(""))) == ""), "must not be empty") for f in ("template", "text")],
)


def _stage_faults(doc: Column, stage: str) -> Column:
    """Faults of a stage: the stage, its list of graphs, each graph, each field."""
    there = _is(doc, "$.stages", "OBJECT")
    object_, graphs = _is(doc, f"$.stages.{stage}", "OBJECT"), _graphs(doc, stage)
    listed = F.coalesce(F.size(graphs), F.lit(0)) > 0
    heads = [
        _fault(there & ~object_, f"$.stages.{stage}", "must be an object"),
        _fault(there & object_ & ~listed, f"$.stages.{stage}.graphs", "must be a non-empty list"),
        *([_fault(F.size(graphs) > 1, "$.stages.codec.graphs", "must hold one graph")] if stage == "codec" else []),
    ]

    def of_graph(g: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"$.stages.{stage}.graphs["), i.cast("string"), F.lit("]"))
        whole = _is(g, "$", "OBJECT")
        found = [_fault(~whole, at, "must be an object")]
        for field in STAGES[stage]:
            n, path = _number(g, f"$.{field}"), F.concat(at, F.lit(f".{field}"))
            found.append(_fault(whole & ~F.coalesce(n > 0, F.lit(False)), path, "must be > 0"))
            if field in LENGTHS:
                found.append(_fault(F.coalesce((n > 0) & (n % GRANULE != 0), F.lit(False)), path, f"must be a multiple of {GRANULE}"))
            if field == "num_lanes":
                found.append(_fault(F.coalesce(n > 1, F.lit(False)), path, "must be 1"))
        return F.array_compact(F.array(*found))

    each = F.coalesce(F.flatten(F.transform(graphs, of_graph)), F.array().cast(f"array<{FAULT}>"))
    return F.concat(F.array_compact(F.array(*heads)), each)


def _across(doc: Column) -> Column:
    """Faults between places: batches of the stages against the scales and each other, where both are there."""
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    return F.array_compact(
        F.array(
            _fault(differ(_batches(doc, "backbone_decode"), _branches(doc)), "$.stages.backbone_decode.graphs", "must match cfg_scales"),
            _fault(differ(_batches(doc, "backbone_prefill"), _batches(doc, "backbone_decode")), "$.stages.backbone_prefill.graphs", "must match backbone_decode"),
            _fault(differ(_batches(doc, "depth_decoder"), _branches(doc)), "$.stages.depth_decoder.graphs", "must match cfg_scales"),
        )
    )


def profile_faults(text: Column) -> Column:
    """array<struct<path, reason>>: every fault of a profile in JSON, in order; empty for a sound one.

    A text that is null or no JSON has one fault at its root. Below a place that is not what it must be nothing is told.
    """

    def of(doc: Column) -> Column:
        places = F.array_compact(F.array(*[_fault(wrong(doc), path, reason) for path, wrong, reason in PLACES]))
        return F.when(doc.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("must be JSON").alias("reason")).cast(FAULT))).otherwise(F.concat(places, *[_stage_faults(doc, s) for s in STAGES], _across(doc)))

    return let(F.try_parse_json(text), of)
