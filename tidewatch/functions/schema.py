"""Declarative field rules for customer tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

NUMERIC, CATEGORICAL, BOOLEAN, DATE, STRING = "numeric", "categorical", "boolean", "date", "string"

_SPARK_TYPES = {
    NUMERIC: T.DoubleType(),
    CATEGORICAL: T.StringType(),
    BOOLEAN: T.BooleanType(),
    DATE: T.DateType(),
    STRING: T.StringType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = field(default=())


def spark_schema(fields: list[Field], as_text: bool = False) -> T.StructType:
    """The StructType to read a file with; ``as_text`` for raw exports."""
    return T.StructType(
        [T.StructField(f.name, T.StringType() if as_text else _SPARK_TYPES[f.kind], True) for f in fields]
    )


def of_kind(fields: list[Field], kind: str, present: list[str]) -> list[Field]:
    return [f for f in fields if f.kind == kind and f.name in present]


YES_NO = ("Yes", "No")
WITH_INTERNET = ("Yes", "No", "No internet service")

# The subscriber table, its ranges and category lists.
SUBSCRIBER_FIELDS = [
    Field("customerID", STRING, required=False),
    Field("gender", CATEGORICAL, allowed=("Male", "Female")),
    Field("SeniorCitizen", BOOLEAN),
    Field("Partner", CATEGORICAL, allowed=YES_NO),
    Field("Dependents", CATEGORICAL, allowed=YES_NO),
    Field("tenure", NUMERIC, low=0, high=100),
    Field("PhoneService", CATEGORICAL, allowed=YES_NO),
    Field("MultipleLines", CATEGORICAL, allowed=("Yes", "No", "No phone service")),
    Field("InternetService", CATEGORICAL, allowed=("DSL", "Fiber optic", "No")),
    Field("OnlineSecurity", CATEGORICAL, allowed=WITH_INTERNET),
    Field("OnlineBackup", CATEGORICAL, allowed=WITH_INTERNET),
    Field("DeviceProtection", CATEGORICAL, allowed=WITH_INTERNET),
    Field("TechSupport", CATEGORICAL, allowed=WITH_INTERNET),
    Field("StreamingTV", CATEGORICAL, allowed=WITH_INTERNET),
    Field("StreamingMovies", CATEGORICAL, allowed=WITH_INTERNET),
    Field("Contract", CATEGORICAL, allowed=("Month-to-month", "One year", "Two year")),
    Field("PaperlessBilling", CATEGORICAL, allowed=YES_NO),
    Field(
        "PaymentMethod",
        CATEGORICAL,
        allowed=("Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)"),
    ),
    Field("MonthlyCharges", NUMERIC, low=0, high=1000),
    Field("TotalCharges", NUMERIC, low=0, high=10000),
]

# The limits a single scoring request must keep.
REQUEST_FIELDS = [
    Field("tenure", NUMERIC, low=0, high=100),
    Field("MonthlyCharges", NUMERIC, low=0, high=500),
    Field("TotalCharges", NUMERIC, low=0, high=10000),
]
