"""Token-watermark detection over paraphrased text, on Spark."""

__version__ = "0.1.0"


def get_version() -> str:
    return __version__


def get_package_info() -> dict[str, str]:
    return {"name": "verdigris", "version": __version__, "description": __doc__.strip()}
