"""Return types of vectorized functions, as objects: they are made where modules load, on workers too."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

STRING, DOUBLE, INT, BOOLEAN = StringType(), DoubleType(), IntegerType(), BooleanType()


def array(of: DataType) -> ArrayType:
    return ArrayType(of)


def struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])
