"""Part of marlstone; see the README for the layout."""
