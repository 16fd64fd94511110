"""Column names, schemas and fixed values shared by the whole library.

Spark reads a dot in a column name as struct access, so raw headers such as
``PM2.5`` are mapped to plain names once, on the way in.
"""

from pyspark.sql import types as T

# Pollutants kept, in display order.
POLLUTANTS = ("no2", "o3", "pm25", "pm10", "so2")

# Order in which pollutants are modelled.
TARGETS = ("o3", "no2", "so2", "pm10", "pm25")

# Bands of each pollutant, worst first, as (lowest, highest).
BANDS = {
    "pm10": ((101, 1200), (51, 100), (36, 50), (21, 35), (0, 20)),
    "pm25": ((51, 800), (26, 50), (21, 25), (11, 20), (0, 10)),
    "no2": ((401, 1000), (201, 400), (101, 200), (41, 100), (0, 40)),
    "o3": ((241, 600), (181, 240), (101, 180), (81, 100), (0, 80)),
    "so2": ((501, 1250), (351, 500), (201, 350), (101, 200), (0, 100)),
}

# Districts shown by default.
DISTRICTS = ("Aveiro", "Lisboa", "Açores", "Setúbal", "Leiria", "Madeira", "Santarém")

# Raw headers and the names used inside.
READING_NAMES = {
    "Coluna1": "site",
    "Distrito": "site",
    "Data": "dt",
    "Data-Hora": "ts",
    "NO2": "no2",
    "O3": "o3",
    "PM2.5": "pm25",
    "PM10": "pm10",
    "SO2": "so2",
}
READING_EXTRAS = ("Tipo", "Zona", "Local")
WEATHER_NAMES = {"date": "dt", "distrito": "site"}

# Weather columns used as model inputs.
WEATHER_FEATURES = (
    "rain",
    "temperature_2m",
    "relative_humidity_2m",
    "temperature_80m",
    "wind_speed_80m",
    "wind_direction_80m",
    "temperature_2m_max",
    "temperature_2m_min",
)

# Weather columns correlated with the mean class and with the pollutants.
WEATHER_VS_CLASS = ("temperature_2m", "relative_humidity_2m", "rain", "wind_speed_80m")
WEATHER_VS_POLLUTANTS = WEATHER_VS_CLASS + ("uv_index_max",)


def class_name(pollutant):
    return f"{pollutant}_cls"


CLASS_COLUMNS = tuple(class_name(p) for p in POLLUTANTS)


def text_schema(names):
    """Every column as text, for raw files whose numbers and dates may be malformed."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def is_numeric(field):
    return isinstance(field.dataType, T.NumericType)
