"""Column layouts of the tables the operators exchange."""

from __future__ import annotations

VOXEL = "volume_id string, c int, z int, y int, x int, v double"
BLOCK = "volume_id string, z0 int, y0 int, x0 int, dims array<int>, data array<float>"
PATCH = "volume_id string, pid bigint, s0 int, s1 int, s2 int"
LOGIT = "volume_id string, k int, z int, y int, x int, l double"
SEGMENT = "volume_id string, z int, y int, x int, label1 int, score1 double, label2 int, score2 double"
WEIGHT = "key string, shape array<int>, data array<float>"

#: Keys of a model description that are read by name; the rest stays in the JSON text.
CONFIGURATION = (
    "patch_size array<int>, normalization_schemes array<string>, pool_op_kernel_sizes array<array<int>>, conv_kernel_sizes array<array<int>>, "
    "n_conv_per_stage_encoder array<int>, n_conv_per_stage_decoder array<int>, UNet_class_name string, UNet_base_num_features int, unet_max_num_features int, "
    "network_arch_class_name string, network_arch_init_kwargs string"
)
INTENSITY = "mean double, std double, percentile_00_5 double, percentile_99_5 double"
PLANS = f"configurations map<string, struct<{', '.join(f'{c.split()[0]}: {c.split(maxsplit=1)[1]}' for c in CONFIGURATION.split(', '))}>>, foreground_intensity_properties_per_channel map<string, struct<mean: double, std: double, percentile_00_5: double, percentile_99_5: double>>"
DATASET = "labels map<string,string>, channel_names map<string,string>, modality map<string,string>"
