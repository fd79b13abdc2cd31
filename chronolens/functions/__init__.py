"""Part of chronolens: functions."""
