"""From model descriptions to networks: old and new formats, defaults, layers and sizes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from math import prod
from operator import add, mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Triple = tuple[int, int, int]
KINDS = ("conv", "bias", "norm", "up", "head")
ROWS = 1 << 16  # models a partition, where they are grouped


def as_list(value, n: int = 3) -> list:
    """A list as it is, a scalar repeated."""
    return list(value) if isinstance(value, (list, tuple)) else [value] * n


def same_padding(kernel) -> list[int]:
    return [(k - 1) // 2 for k in kernel]


def stage_features(n: int, base: int = 32, most: int = 320) -> list[int]:
    """Widths doubling from stage to stage up to a limit."""
    return [min(base * 2**i, most) for i in range(n)]


def stage_features_column(n: Column, base: Column, most: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(base * F.pow(F.lit(2), i), most).cast("int"))


@dataclass(frozen=True)
class Architecture:
    """What a network is made of; lists run over stages."""

    in_channels: int
    classes: int
    features: list[int]
    kernels: list[list[int]]
    strides: list[list[int]]
    encoder_convs: list[int]
    decoder_convs: list[int]
    residual: bool = False
    bias: bool = True
    stem: int | None = None
    eps: float = 1e-5
    slope: float = 0.01
    deep_supervision: bool = False
    options: dict = field(default_factory=dict)

    @property
    def n_stages(self) -> int:
        return len(self.features)

    def layers(self) -> list[tuple[str, str, tuple[int, ...]]]:
        """Every parameter as (key, kind, stored shape)."""
        out: list[tuple[str, str, tuple[int, ...]]] = []

        def block(key: str, o: int, i: int, kernel) -> None:
            out.append((f"{key}.conv.weight", "conv", (o, i, *kernel)))
            if self.bias:
                out.append((f"{key}.conv.bias", "bias", (o,)))
            out.extend((f"{key}.norm.{n}", "norm", (o,)) for n in ("weight", "bias"))

        width = self.in_channels
        if self.residual:
            width = self.stem or self.features[0]
            block("encoder.stem.convs.0", width, self.in_channels, self.kernels[0])
        for s, o in enumerate(self.features):
            for n in range(self.encoder_convs[s]):
                if self.residual:
                    key = f"encoder.stages.{s}.blocks.{n}"
                    block(f"{key}.conv1", o, width, self.kernels[s])
                    block(f"{key}.conv2", o, o, self.kernels[s])
                    if width != o:
                        block(f"{key}.skip", o, width, (1, 1, 1))
                else:
                    block(f"encoder.stages.{s}.convs.{n}", o, width, self.kernels[s])
                width = o
        for s in range(self.n_stages - 1):
            o = self.features[-(s + 2)]
            stride = self.strides[-(s + 1)]
            out.append((f"decoder.transpconvs.{s}.weight", "up", (width, o, *stride)))
            if self.bias:
                out.append((f"decoder.transpconvs.{s}.bias", "bias", (o,)))
            for n in range(self.decoder_convs[s]):
                block(f"decoder.stages.{s}.convs.{n}", o, 2 * o if n == 0 else o, self.kernels[-(s + 2)])
            # every stage has a head; those before the last only speak under deep supervision
            out.append((f"decoder.seg_layers.{s}.weight", "head", (self.classes, o, 1, 1, 1)))
            out.append((f"decoder.seg_layers.{s}.bias", "bias", (self.classes,)))
            width = o
        return out

    def parameters(self) -> int:
        return sum(prod(shape) for _, _, shape in self.layers())

    def layer_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, kind, list(s)) for k, kind, s in self.layers()], "key string, kind string, shape array<int>")


def from_plans(plans: dict, in_channels: int, classes: int, configuration: str = "3d_fullres", deep_supervision: bool = False) -> Architecture:
    """The network of a description: with explicit network arguments (top level first, then the configuration's), or by pooling sizes."""
    config = plans["configurations"][configuration]
    given = plans.get("network_arch_init_kwargs") or config.get("network_arch_init_kwargs")
    if given:
        name = plans.get("network_arch_class_name") or config.get("network_arch_class_name") or "PlainConvUNet"
        residual, n = "ResidualEncoder" in name, given["n_stages"]
        spread = lambda v: [as_list(x) for x in as_list(v, n)]
        convs = given.get("n_blocks_per_stage", [1] * n) if residual else given.get("n_conv_per_stage", [2] * n)
        nonlin = {k: v for k, v in (given.get("nonlin_kwargs") or {}).items() if k != "inplace"}
        decoder = given.get("n_conv_per_stage_decoder", [1 if residual else 2] * (n - 1))
        return Architecture(
            in_channels, classes, as_list(given["features_per_stage"], n), spread(given["kernel_sizes"]), spread(given["strides"]), as_list(convs, n), as_list(decoder, n - 1), residual, given.get("conv_bias", True),
            given.get("stem_channels") if residual else None, (given.get("norm_op_kwargs") or {}).get("eps", 1e-5), nonlin.get("negative_slope", 0.01), deep_supervision, nonlin,
        )
    kernels = config["conv_kernel_sizes"]
    residual = "ResidualEncoder" in config.get("UNet_class_name", "PlainConvUNet")
    widths = stage_features(len(kernels), config.get("UNet_base_num_features", 32), config.get("unet_max_num_features", 320))
    return Architecture(in_channels, classes, widths, [list(k) for k in kernels], [list(s) for s in config["pool_op_kernel_sizes"]], config["n_conv_per_stage_encoder"], config["n_conv_per_stage_decoder"], residual, not residual, deep_supervision=deep_supervision)


def defaulted(rows: DataFrame) -> DataFrame:
    """Descriptions (``json``) with their defaults, as columns, for many models at once."""
    text = lambda path: F.get_json_object("json", path)
    kwargs = F.from_json(F.coalesce(text("$.nonlin_kwargs"), F.lit("{}")), "map<string,string>")
    clean = F.map_filter(kwargs, lambda k, _: k != "inplace")
    return rows.select(
        "*",
        F.coalesce(text("$.class_name"), F.lit("PlainConvUNet")).alias("class_name"),
        F.contains(F.coalesce(text("$.class_name"), F.lit("PlainConvUNet")), F.lit("ResidualEncoder")).alias("residual"),
        F.coalesce(text("$.base").cast("int"), F.lit(32)).alias("base"),
        F.coalesce(text("$.most").cast("int"), F.lit(320)).alias("most"),
        F.coalesce(text("$.conv_bias").cast("boolean"), F.lit(True)).alias("conv_bias"),
        F.coalesce(F.try_element_at(clean, F.lit("negative_slope")).cast("double"), F.lit(0.01)).alias("slope"),
        F.size(clean).alias("n_options"),
    )


def dealt(models: DataFrame) -> DataFrame:
    """``models`` dealt by ``model`` over as many partitions as their number asks for, whatever the layout of their files.

    What is grouped by model after a narrow step is then grouped where it lies, some ``ROWS`` models a task.
    """
    return models.repartition(max(1, -(-models.count() // ROWS)), "model")


def _stages(models: DataFrame, in_channels: int) -> DataFrame:
    """A row a stage ``_s``: its width, that of its input, and those below and beside its decoder (the last stage has none)."""
    widths = models.withColumn("_w", stage_features_column(F.col("n"), F.col("base"), F.col("most")))
    s, n, at = F.col("_s"), F.col("n"), lambda i: F.get("_w", i)
    staged = widths.withColumn("_s", F.explode(F.sequence(F.lit(0), n - 1)))
    wide = F.when(s == 0, F.lit(in_channels)).otherwise(at(s - 1))
    return staged.select("model", "classes", "_s", (s < n - 1).alias("_decodes"), at(s).alias("_o"), wide.alias("_i"), at(n - 1 - s).alias("_low"), at(n - 2 - s).alias("_skip"))


def _parts() -> tuple[list[tuple], list[tuple]]:
    """``key, kind, shape`` of what a stage has in the encoder and in the decoder, as columns over the rows of :func:`_stages`."""
    s, o, i, low, skip = (F.col(c) for c in ("_s", "_o", "_i", "_low", "_skip"))
    three = [F.lit(3)] * 3
    named = lambda a, b: F.concat(F.lit(a), s.cast("string"), F.lit(b))

    def block(key: Column, o: Column, i: Column) -> list[tuple]:
        ends = (("conv.weight", "conv", (o, i, *three)), ("conv.bias", "bias", (o,)), ("norm.weight", "norm", (o,)), ("norm.bias", "norm", (o,)))
        return [(F.concat(key, F.lit(f".{end}")), kind, shape) for end, kind, shape in ends]

    encoder = [x for c in range(2) for x in block(named("encoder.stages.", f".convs.{c}"), o, o if c else i)]
    decoder = [(named("decoder.transpconvs.", ".weight"), "up", (low, skip, *[F.lit(2)] * 3)), (named("decoder.transpconvs.", ".bias"), "bias", (skip,))]
    decoder += [x for c in range(2) for x in block(named("decoder.stages.", f".convs.{c}"), skip, skip if c else 2 * skip)]
    decoder += [(named("decoder.seg_layers.", ".weight"), "head", (F.col("classes"), skip, *[F.lit(1)] * 3)), (named("decoder.seg_layers.", ".bias"), "bias", (F.col("classes"),))]
    return encoder, decoder


def layer_rows(models: DataFrame, in_channels: int = 1, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``model, key, kind, shape`` of every parameter of many plain networks at once, or of those of some kinds.

    ``models`` has ``model, n`` (stages), ``base, most, classes``: kernels of 3 a side, strides of 2 between stages, two
    convolutions a stage.  A narrow expansion of each row; the names and shapes are those of :class:`Architecture`.
    """
    stages, halves = _stages(models, in_channels), []
    for df, parts in zip((stages, stages.where("_decodes")), _parts()):
        found = [F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.array(*shape).alias("shape")) for key, kind, shape in parts if kind in kinds]
        if found:
            halves.append(df.select("model", F.explode(F.array(*found)).alias("p")).select("model", "p.key", "p.kind", "p.shape"))
    return reduce(DataFrame.unionByName, halves)


def layer_sums(models: DataFrame, in_channels: int = 1) -> DataFrame:
    """``model, kind, tensors, parameters`` of every stage: the rows of :func:`layer_rows` counted, and their sizes summed, without naming them.

    A narrow expansion in one pass, so that what :func:`dealt` has put together stays so.
    """
    product = lambda shape: reduce(mul, shape, F.lit(1).cast("long"))
    encoder, decoder = ([(kind, product(shape)) for _, kind, shape in parts] for parts in _parts())
    decodes, found = F.col("_decodes"), []
    for kind in KINDS:
        both = [x for k, x in encoder if k == kind], [x for k, x in decoder if k == kind]
        tensors = F.lit(len(both[0])).cast("long") + F.when(decodes, F.lit(len(both[1]))).otherwise(F.lit(0))
        sizes = both[0] + [F.when(decodes, x) for x in both[1]]  # what is null adds nothing, as in a sum over rows
        total = F.when(F.coalesce(*sizes).isNotNull(), reduce(add, [F.coalesce(x, F.lit(0)) for x in sizes]))
        found.append(F.struct(F.lit(kind).alias("kind"), tensors.alias("tensors"), total.alias("parameters")))
    return _stages(models, in_channels).select("model", F.inline(F.array(*found))).where("tensors > 0")


def activation_bytes(patch: Column, widths: Column, bytes_each: int = 4) -> Column:
    """Bytes of the features of both halves of a network over one patch; each stage halves the patch's axes."""
    place = lambda p, i: F.floor(p / F.pow(F.lit(2), i)).cast("long")
    voxels = lambda i: F.aggregate(patch, F.lit(1).cast("long"), lambda a, p: a * place(p, i))
    each = F.transform(widths, lambda f, i: f.cast("long") * voxels(i) * bytes_each * 2)
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x) * 2


def batch_size(patch: Column, classes: Column, memory: Column, bytes_each: int = 4) -> Column:
    """Patches that fit into ``memory`` at a time, from 1 to 8."""
    widths = F.array(*[F.lit(f) for f in stage_features(6)])
    scores = F.aggregate(patch, F.lit(1).cast("long"), lambda a, p: a * p) * classes * bytes_each
    fits = (memory * 0.85 / (activation_bytes(patch, widths, bytes_each) * 3 + scores)).cast("int")
    return F.greatest(F.least(fits, F.lit(8)), F.lit(1))


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON file from anywhere Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return json.loads(rows[0][0])
