"""What a user can put right."""


class AppError(ValueError):
    pass


class VideoDataError(AppError):
    pass


class ArtifactPublicationError(AppError):
    pass


class SubtitleError(AppError):
    pass


class LibraryError(AppError):
    pass


class InvalidLibraryError(LibraryError):
    pass


class QualityCorpusError(AppError):
    pass
