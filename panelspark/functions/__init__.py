from panelspark.functions import numeric, stats, text  # noqa: F401
