"""Part of chronolens: sources."""
