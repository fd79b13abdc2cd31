"""Part of chronolens: operators."""
