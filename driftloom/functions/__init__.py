"""See README.md for what this part of the library offers."""
