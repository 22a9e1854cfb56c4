"""Load-profile and weather-series analytics as plain DataFrame functions."""
