from skein.functions import numeric, text, vectors  # noqa: F401
