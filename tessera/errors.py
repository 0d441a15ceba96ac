"""What can be wrong with a configuration, with data, or with what two parts expect of each other."""


def brief(value: object, most: int = 80) -> str:
    """repr of value for a message, its middle left out beyond `most` characters."""
    text = repr(value)
    half = (most - 3) // 2
    return text if len(text) <= most else f"{text[: most - 3 - half]}...{text[len(text) - half :]}"


class ConfigError(ValueError):
    pass


class DataError(ValueError):
    pass


class ContractError(AssertionError):
    pass
