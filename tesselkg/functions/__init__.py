"""Part of tesselkg; see the README for what lives here."""
