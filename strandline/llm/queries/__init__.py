"""The thin queries opN_<name>."""
