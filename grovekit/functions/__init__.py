"""grovekit subpackage."""
