"""Entity contracts: explicit schemas checked where a table enters the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T

PERSON = "person_id"
INDEX = "index_date"
TIME = "event_time"

_L, _S, _D = T.LongType(), T.StringType(), T.DateType()
_NTZ, _I, _B = T.TimestampNTZType(), T.IntegerType(), T.BooleanType()
_NUM = T.DecimalType(38, 9)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


SPELL = _schema(person_id=_L, start_date=_D, end_date=_D, service_type=_S, postcode=_S)
PERSON_TABLE = _schema(person_id=_L, birth_date=_D, death_date=_D, gender=_S)
OBSERVATION = _schema(person_id=_L, ob_end=_D)
DEATH_REGISTRY = _schema(
    person_id=_L, dod=_D, reg_date=_D, end_date=_D,
    cause_code_1=_S, cause_code_4=_S,
)
CODED_EVENT = _schema(person_id=_L, event_time=_NTZ, code=_S, text=_S, value=_NUM)
MEDICATION = _schema(person_id=_L, event_time=_NTZ, drug_id=_S, is_repeat=_B)
EPISODE = _schema(
    person_id=_L, event_time=_NTZ, end_time=_NTZ, episode_sequence=_I,
    diagnosis_1=_S, diagnosis_2=_S, diagnosis_3=_S, diagnosis_4=_S,
)
PERSON_AREA = _schema(person_id=_L, area=_S)
AREA_INDEX = _schema(area=_S, decile=_I)
OUTCOME_EVENT = _schema(person_id=_L, event_time=_NTZ, event_type=_S)


def conform(df: DataFrame, schema: T.StructType, **source: str | Column) -> DataFrame:
    """Select and cast ``df`` to ``schema``.

    ``source`` maps a contract column to the column that feeds it (default: the
    same name).  Casts are ``try_cast`` so malformed cells turn NULL, and
    string booleans (``true/false/yes/no/1/0``) become real ones.  A contract
    column that is not in ``df`` and not mapped is an error.
    """
    out = []
    for field in schema.fields:
        src = source.get(field.name, field.name)
        if isinstance(src, str):
            if src not in df.columns:
                raise ValueError(f"no column {src!r} for contract column {field.name!r}")
            src = df[src]
        out.append(src.try_cast(field.dataType).alias(field.name))
    return df.select(*out)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early, on the driver, when a plan lacks a column it is keyed on."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")
    return df
