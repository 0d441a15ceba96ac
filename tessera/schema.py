"""The two tables that everything works on."""

from pyspark.sql import types as T

GROUP_SCHEMA = T.StructType.fromDDL("uid bigint, prompt string, responses array<string>, ranking array<int>, scores array<double>, slices map<string,string>")
PAIR_SCHEMA = T.StructType.fromDDL("pair_uid bigint, group_uid bigint, chosen_idx int, rejected_idx int, prompt string, chosen string, rejected string, slices map<string,string>, margin_hint double")
