"""Part of chronolens: plans."""
